"""Registered queries: files, loaders, chunk tables, ids, pages, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.languages import LANGUAGE_OF, SUPPORTED_EXTENSIONS
from corpusloom.operators import chunking, loading, ranking, registry_ops, sparse, web
from corpusloom.plans.registry import CHILDREN_SQL, INDEX_SQL, PARENTS_SQL, Tables, bm25_sql, query
from corpusloom.plans.search import child_index
from corpusloom.session import few


@query("document_scan", """SELECT doc_id AS file_id, 0 AS doc_seq, length(text) AS text_length, n_chars = length(text) AS length_agrees,
  'TextLoader' AS document_loader FROM documents""")
def document_scan(t: Tables) -> DataFrame:
    return t.files().select(
        "file_id", F.lit(0).alias("doc_seq"), F.length("text").cast("long").alias("text_length"),
        (F.col("n_chars") == F.length("text")).alias("length_agrees"), F.lit("TextLoader").alias("document_loader"),
    )


# Documents get a path whose extension depends on their language, so that every route has files.
EXTENSION_SQL = "CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.py' WHEN 'es' THEN '.html' ELSE '.txt' END"
PATHS_SQL = f"""paths AS (SELECT doc_id AS file_id, '/corpus/' || source || '/' || doc_id || {EXTENSION_SQL} AS path, length(text) AS text_length FROM documents
  UNION ALL SELECT -1 - page_id, regexp_replace(url, '^https?:/', ''), length(html) FROM pages)"""


def extension_of_language():
    return F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".py").when(F.col("lang") == "es", ".html").otherwise(".txt")


def paths(t: Tables) -> DataFrame:
    docs = t.documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), extension_of_language()).alias("path"),
        F.length("text").alias("text_length"),
    )
    pages = t.pages.select((-1 - F.col("page_id")).alias("file_id"), F.regexp_replace("url", "^https?:/", "").alias("path"), F.length("html").alias("text_length"))
    return docs.unionByName(pages)


SUPPORTED_SQL = ", ".join(f"'{e}'" for e in SUPPORTED_EXTENSIONS)


@query("file_registry", f"""WITH {PATHS_SQL}, x AS (SELECT *, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS file_extension FROM paths)
SELECT file_id, regexp_replace(path, '/[^/]*$', '') AS file_directory, regexp_extract(path, '[^/]*$') AS file_name, file_extension,
  CASE WHEN file_extension NOT IN ({SUPPORTED_SQL}) THEN 'unsupported_type:' || file_extension END AS reject_reason FROM x""")
def file_registry(t: Tables) -> DataFrame:
    rows = registry_ops.registry_rows(paths(t))
    return rows.select("file_id", "file_directory", "file_name", "file_extension", "reject_reason")


LANGUAGE_SQL = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in LANGUAGE_OF.items()) + " END"


@query("chunk_route", f"""SELECT doc_id AS file_id, ext AS file_extension, {LANGUAGE_SQL} AS language,
  CASE WHEN ext = '.md' THEN 'MarkdownTextSplitterAdapter' WHEN ext IN ('.html', '.htm') THEN 'HTMLTextSplitterAdapter'
       WHEN {LANGUAGE_SQL} IS NOT NULL THEN 'CodeTextSplitter(' || {LANGUAGE_SQL} || ')' ELSE 'UniversalTextSplitter' END AS splitter,
  ext IN ('.md', '.py', '.txt') AND length(text) < 1500 AS keeps_whole
FROM (SELECT *, {EXTENSION_SQL} AS ext FROM documents)""")
def chunk_route(t: Tables) -> DataFrame:
    ext = F.col("file_extension")
    return t.documents.select(F.col("doc_id").alias("file_id"), "text", extension_of_language().alias("file_extension")).select(
        "file_id", "file_extension", chunking.language_of(ext).alias("language"), chunking.splitter_for(ext).alias("splitter"),
        chunking.keeps_whole(ext, F.length("text")).alias("keeps_whole"),
    )


@query("chunk_windows", f"WITH {PARENTS_SQL} SELECT parent_id, file_id, parent_index, text FROM parents")
def chunk_windows(t: Tables) -> DataFrame:
    return t.parents().select("parent_id", "file_id", "parent_index", "text")


@query("chunk_children", f"WITH {CHILDREN_SQL} SELECT child_id, parent_id, child_index, start_index, text FROM children")
def chunk_children(t: Tables) -> DataFrame:
    return t.children().select("child_id", "parent_id", "child_index", "start_index", "text")


@query("chunk_recursive_parents")
def chunk_recursive_parents(t: Tables) -> DataFrame:
    return chunking.split_rows(t.files().select("file_id", "text"), chunking.PARENT_SIZE, chunking.PARENT_OVERLAP)


@query("chunk_recursive_children")
def chunk_recursive_children(t: Tables) -> DataFrame:
    parents = chunk_recursive_parents(t).select("file_id", F.col("chunk_index").alias("parent_index"), "text")
    return chunking.split_rows(parents, chunking.CHILD_SIZE, chunking.CHILD_OVERLAP)


@query("chunk_code")
def chunk_code(t: Tables) -> DataFrame:
    """Every document split with the separators of the language its path stands for."""
    files = t.documents.select(F.col("doc_id").alias("file_id"), "text", chunking.language_of(extension_of_language()).alias("language"))
    return chunking.split_rows(files, chunking.PARENT_SIZE, chunking.PARENT_OVERLAP, language="language")


@query("chunk_flat_preset")
def chunk_flat_preset(t: Tables) -> DataFrame:
    return chunking.flat_preset(t.files().select("file_id", "text"))


def typed_files(t: Tables) -> DataFrame:
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), extension_of_language().alias("file_extension"), "text")
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"), F.lit(".html").alias("file_extension"), F.col("html").alias("text"))
    markdown = t.pages.select(F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("file_id"), F.lit(".md").alias("file_extension"), H.to_markdown(F.col("html")).alias("text"))
    return docs.unionByName(pages).unionByName(markdown)


@query("ingest_parents")
def ingest_parents(t: Tables) -> DataFrame:
    return chunking.ingest(typed_files(t))[0]


@query("ingest_children")
def ingest_children(t: Tables) -> DataFrame:
    return chunking.ingest(typed_files(t))[1]


def strict_lines(source: loading.Source) -> list[loading.Part]:
    """A splitter of somebody else: groups of ten lines, and no text of more than 3,000 characters."""
    if len(source.text) > 3000:
        raise ValueError(f"{len(source.text)} characters")
    lines = source.text.split("\n")
    return [loading.Part("\n".join(lines[i : i + 10])) for i in range(0, len(lines), 10)]


REGISTRY = loading.STANDARD.register(loading.Splitter("StrictLines", (".py", ".txt"), strict_lines, order=5))
#: German documents go to the strict splitter; others that are short plain texts are never split.
REFUSED_SQL = f"""SELECT 'd' || doc_id AS file_id, {EXTENSION_SQL} AS file_extension,
  CASE WHEN text IS NULL THEN 'no text' ELSE 'ValueError: ' || length(text) || ' characters' END AS error
  FROM documents WHERE text IS NULL OR length(text) > 3000 AND coalesce(lang, '') NOT IN ('en', 'es')
  UNION ALL SELECT 'p' || page_id, '.html', 'no text' FROM pages WHERE html IS NULL"""


@query("ingest_rejects", REFUSED_SQL)
def ingest_rejects(t: Tables) -> DataFrame:
    """Files that a registered splitter refuses."""
    files = typed_files(t).where(~F.col("file_id").startswith("m"))
    return loading.load(files, REGISTRY).rejects()


@query("ingest_lines", f"""WITH f AS (SELECT 'd' || doc_id AS file_id, text, length(text) < 1500 AS whole FROM documents WHERE lang = 'de' AND length(text) <= 3000),
l AS (SELECT *, CASE WHEN whole THEN [text] ELSE string_split(text, chr(10)) END AS lines FROM f)
SELECT file_id, i::INTEGER AS parent_index, array_to_string(lines[i * 10 + 1:i * 10 + 10], chr(10)) AS text, CASE WHEN whole THEN '' ELSE 'StrictLines' END AS splitter
FROM (SELECT *, unnest(range(0, (len(lines) + 9) // 10)) AS i FROM l)""")
def ingest_lines(t: Tables) -> DataFrame:
    """What the registered splitter gives for the files that it takes."""
    found = loading.load(typed_files(t).where(F.col("file_extension") == ".py"), REGISTRY).parents()
    return found.select("file_id", "parent_index", "text", F.array_join("text_splitters", ">").alias("splitter"))


FILES_SQL = f"""files AS (SELECT 'd' || doc_id AS file_id, {EXTENSION_SQL} AS ext, text FROM documents WHERE text IS NOT NULL)"""


@query("ingest_checked", f"""WITH {FILES_SQL} SELECT file_id, true AS numbered, true AS parents_fit, true AS children_fit, true AS children_inside, true AS words_kept FROM files WHERE trim(text) <> ''""")
def ingest_checked(t: Tables) -> DataFrame:
    """For each document whether its chunks are sound: numbers without gaps, sizes, children inside parents, no word lost."""
    docs = typed_files(t).where(F.col("file_id").startswith("d") & F.col("text").isNotNull() & (F.trim("text") != ""))
    found = loading.load(docs)
    parents = found.parents().select("file_id", "parent_id", "parent_index", "text", F.size("text_splitters").alias("steps"))
    children = found.children().select("parent_id", F.col("text").alias("child"), "start_index")
    inside = children.join(parents.select("parent_id", "text"), "parent_id").groupBy("parent_id").agg(
        F.max(F.length("child")).alias("longest"), F.bool_and(F.expr("substr(text, start_index + 1, length(child)) = child")).alias("inside")
    )
    each = parents.join(inside, "parent_id", "left").groupBy("file_id").agg(
        (F.max("parent_index") + 1 == F.count("*")).alias("numbered"),
        F.bool_and((F.length("text") <= chunking.PARENT_SIZE) | (F.col("steps") == 0)).alias("parents_fit"),
        F.bool_and(F.coalesce("longest", F.lit(0)) <= chunking.CHILD_SIZE).alias("children_fit"), F.bool_and(F.coalesce("inside", F.lit(True))).alias("children_inside"),
        F.array_distinct(F.flatten(F.collect_list(F.split("text", r"\s+")))).alias("words"),
    )
    whole = docs.select("file_id", F.array_distinct(F.split(F.regexp_replace("text", "<[^>]*>", " "), r"\s+")).alias("wanted"))
    lost = F.size(F.array_except(F.array_remove("wanted", ""), "words"))
    return each.join(whole, "file_id").select("file_id", "numbered", "parents_fit", "children_fit", "children_inside", (lost == 0).alias("words_kept"))


# --- web pages -----------------------------------------------------------------------------------------------


def cleaned_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in H.BOILERPLATE_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    return f"""regexp_replace({out}, '(?is)<div class="ad"[^>]*>.*?</div\\s*>', '', 'g')"""


def unescape_sql(text: str) -> str:
    for entity, char in H.ENTITIES:
        shown = char.replace("'", "''")
        text = f"replace({text}, '{entity}', '{shown}')"
    return text


def strip_sql(html: str) -> str:
    lines = f"regexp_replace({html}, '(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|article|section)\\s*>', chr(10), 'g')"
    text = unescape_sql(f"regexp_replace({lines}, '(?s)<[^>]*>', '', 'g')")
    text = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"


TITLE_SQL = unescape_sql("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")
ARTICLE_SQL = f"regexp_extract({cleaned_sql('html')}, '(?is)<article[^>]*>(.*)</article>', 1)"
BODY_SQL = f"""regexp_replace(regexp_replace(regexp_replace({cleaned_sql('html')}, '(?is)<head(\\s[^>]*)?>.*?</head\\s*>', '', 'g'), '(?is)^.*?<body[^>]*>', ''), '(?is)</body\\s*>.*$', '')"""


@query("html_extract", f"""SELECT page_id, {TITLE_SQL} AS title, regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
  nullif({strip_sql(ARTICLE_SQL)}, '') AS text FROM pages""")
def html_extract(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select("page_id", H.title(html).alias("title"), H.page_language(html).alias("lang"), H.main_text(html).alias("text"))


@query("page_content", f"""SELECT page_id, {TITLE_SQL} AS title, regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
  nullif({strip_sql(ARTICLE_SQL)}, '') AS text, 0::BIGINT AS n_links, NULL::VARCHAR AS author FROM pages""")
def page_content(t: Tables) -> DataFrame:
    """Pages by their blocks. The given ones are simple enough for expressions to say the same."""
    rows = web.page_content(t.pages.select("page_id", "html"))
    return rows.select("page_id", "title", "lang", "text", F.size("links").cast("long").alias("n_links"), "author")


@query("loader_chain", f"""WITH x AS (SELECT page_id, nullif({strip_sql(ARTICLE_SQL)}, '') AS a, nullif({strip_sql(BODY_SQL)}, '') AS b, nullif({TITLE_SQL}, '') AS c FROM pages)
SELECT page_id, coalesce(CASE WHEN contains(a, '***') THEN NULL ELSE a END, b, c) AS text,
  CASE WHEN NOT contains(a, '***') THEN 'main' WHEN b IS NOT NULL THEN 'body' WHEN c IS NOT NULL THEN 'title' END AS document_loader FROM x""")
def loader_chain(t: Tables) -> DataFrame:
    """Main-content loader first; pages whose main text is junk-marked fall back to the whole body, then to the title."""
    html = F.col("html")
    pages = t.pages.select("page_id", H.main_text(html).alias("a"), H.body_text(html).alias("b"), F.nullif(H.title(html), F.lit("")).alias("c"))
    main = F.when(~F.col("a").contains("***"), F.col("a"))
    return pages.select("page_id", *[c.alias(n) for n, c in registry_ops.first_loader({"main": main, "body": F.col("b"), "title": F.col("c")}).items()])


SECTION_TEXT_SQL = strip_sql("raw")


@query("html_sections", f"""WITH parts AS (SELECT page_id, i, parts[i] AS raw FROM (
    SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT page_id, string_split(regexp_replace({BODY_SQL}, '(?i)<(h[12][\\s>])', chr(1) || '<\\1', 'g'), chr(1)) AS parts FROM pages))),
x AS (SELECT page_id, i, {SECTION_TEXT_SQL} AS text, nullif(regexp_extract(raw, '(?i)^<h([12])', 1), '') AS level,
    trim({unescape_sql("regexp_replace(regexp_extract(raw, '(?is)^<h[12][^>]*>(.*?)</h[12]\\s*>', 1), '<[^>]*>', '', 'g')")}) AS heading FROM parts),
y AS (SELECT *, last_value(CASE WHEN level = '1' THEN heading END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS header_1,
    last_value(CASE WHEN level = '1' THEN i END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS h1_at,
    last_value(CASE WHEN level = '2' THEN heading END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS h2,
    last_value(CASE WHEN level = '2' THEN i END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS h2_at FROM x)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS section_index, text, header_1,
  CASE WHEN h2_at > coalesce(h1_at, 0) THEN h2 END AS header_2 FROM y WHERE text <> ''""")
def html_sections(t: Tables) -> DataFrame:
    return chunking.html_sections(t.pages, "page_id")


MARKDOWN_TEXT_SQL = f"regexp_replace({BODY_SQL}, '\\s*\\n\\s*', ' ', 'g')"
for _level in (1, 2, 3):
    MARKDOWN_TEXT_SQL = f"regexp_replace({MARKDOWN_TEXT_SQL}, '(?is)<h{_level}[^>]*>(.*?)</h{_level}\\s*>', chr(10) || '{'#' * _level} \\1' || chr(10), 'g')"
MARKDOWN_TEXT_SQL = strip_sql(MARKDOWN_TEXT_SQL)


@query("markdown_sections", f"""WITH lines AS (SELECT page_id, i, trim(l[i]) AS raw FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT page_id, string_split(md, chr(10)) AS l FROM (SELECT page_id, {MARKDOWN_TEXT_SQL} AS md FROM pages)))),
x AS (SELECT *, regexp_matches(raw, '^#( |$)') AS is_h1 FROM lines WHERE raw <> ''),
y AS (SELECT *, coalesce(sum(is_h1::INT) OVER (PARTITION BY page_id ORDER BY i), 0) AS section FROM x)
SELECT page_id, (dense_rank() OVER (PARTITION BY page_id ORDER BY section) - 1)::INTEGER AS section_index,
  string_agg(raw, chr(10) ORDER BY i) AS text, trim(regexp_replace(max(CASE WHEN is_h1 THEN raw END), '^#+', '')) AS header_1, NULL::VARCHAR AS header_2
FROM y GROUP BY page_id, section""")
def markdown_sections(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", H.to_markdown(F.col("html")).alias("text"))
    return chunking.markdown_sections(pages, "page_id")


@query("section_merge")
def section_merge(t: Tables) -> DataFrame:
    return chunking.structured_parents(html_sections(t), "page_id")


# --- ids, pages, merges, deletes -----------------------------------------------------------------------------


@query("chunk_ids", f"""WITH {PARENTS_SQL}, p AS (SELECT file_id, parent_index, text, sha256(concat_ws('|', file_id, parent_index, text)) AS parent_id FROM parents),
c AS (SELECT file_id, parent_id, parent_index, i::INTEGER AS child_index, substr(text, i * 206 + 1, 256) AS ctext
  FROM (SELECT *, unnest(range(0, (greatest(length(text) - 50, 1) - 1) // 206 + 1)) AS i FROM p))
SELECT sha256(concat_ws('|', parent_id, child_index, ctext)) AS child_id, parent_id, file_id, parent_index, child_index,
  (count(*) OVER (PARTITION BY parent_id))::INTEGER AS children_count FROM c""")
def chunk_ids(t: Tables) -> DataFrame:
    linked = chunking.linked_chunks(t.files().select("file_id", "text"))
    return linked.select("parent_id", "file_id", "parent_index", "children_count", F.explode("children").alias("c")).select(
        "c.child_id", "parent_id", "file_id", "parent_index", "c.child_index", "children_count"
    )


@query("chunk_page", f"""WITH {PARENTS_SQL} SELECT file_id, parent_index, parent_id, total FROM (
  SELECT *, count(*) OVER (PARTITION BY file_id) AS total FROM parents) WHERE parent_index >= 2 AND parent_index < 2 + 5""")
def chunk_page(t: Tables) -> DataFrame:
    rows = chunking.page(t.parents().select("file_id", "parent_index", "parent_id"), "file_id", "parent_index", F.lit(2), F.lit(5))
    return rows.select("file_id", "parent_index", "parent_id", "total")


@query("merge_consecutive", f"""WITH {INDEX_SQL}{bm25_sql('b', 30, False)},
got AS (SELECT DISTINCT query_id, parent_id FROM b JOIN children USING (child_id)),
runs AS (SELECT query_id, p.file_id, p.parent_index, p.parent_id, p.text, parent_index - row_number() OVER (PARTITION BY query_id, p.file_id ORDER BY parent_index) AS run
  FROM got JOIN parents p USING (parent_id))
SELECT query_id, file_id, min_by(parent_id, parent_index) AS parent_id, min(parent_index) AS parent_index, count(*) AS merged_count,
  string_agg(text, chr(10) || chr(10) ORDER BY parent_index) AS text FROM runs GROUP BY query_id, file_id, run""")
def merge_consecutive(t: Tables) -> DataFrame:
    """Neighbouring parents among each passage's results, joined into the first of each run."""
    found = sparse.bm25(t.passages(), child_index(t), 30)
    parents = ranking.backtrack(found, t.children().select("child_id", "parent_id"), ["query_id"]).select("query_id", "parent_id")
    texts = few(parents).join(t.parents().select("parent_id", "file_id", "parent_index", "text"), "parent_id")
    return chunking.merge_consecutive(texts, ["query_id", "file_id"])


@query("load_summary", f"""WITH {CHILDREN_SQL}, k AS (SELECT file_id, count(*) AS children_count FROM children GROUP BY 1)
SELECT file_id, count(*) AS parent_count, sum(length(text))::BIGINT AS total_chars, max(length(text))::INTEGER AS max_chars, 'windows' AS splitter, any_value(children_count) AS children_count
FROM parents JOIN k USING (file_id) GROUP BY file_id""")
def load_summary(t: Tables) -> DataFrame:
    parents = t.parents().withColumn("text_splitters", F.array(F.lit("windows")))
    return chunking.load_summary(parents, t.children())


@query("cascade_delete", f"""WITH {CHILDREN_SQL}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'files' AS table_name, count(*) AS kept FROM documents WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'parents', count(*) FROM parents WHERE file_id NOT IN (FROM gone)
UNION ALL SELECT 'children', count(*) FROM children WHERE file_id NOT IN (FROM gone)""")
def cascade_delete(t: Tables) -> DataFrame:
    """Files judged toxic leave every table."""
    doomed = t.labels.where(F.col("toxic") == 1).select("doc_id")
    tables = {"files": t.files().select("file_id"), "parents": t.parents().select("file_id"), "children": t.children().select("file_id")}
    kept = registry_ops.delete_cascade(tables, doomed, dict.fromkeys(tables, "file_id"))
    counts = [df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table_name"), "kept") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("children_of_parents", f"""WITH {CHILDREN_SQL}, wanted AS (SELECT parent_id FROM parents JOIN labels ON doc_id = file_id WHERE quality = 1)
SELECT parent_id, child_id, start_index FROM wanted JOIN children USING (parent_id)""")
def children_of_parents(t: Tables) -> DataFrame:
    good = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("file_id"))
    wanted = t.parents().join(good, "file_id").select("parent_id")
    return wanted.join(t.children().select("parent_id", "child_id", "start_index"), "parent_id")


@query("parents_without_children", f"""WITH {CHILDREN_SQL}, kept AS (SELECT * FROM children WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT parent_id FROM parents JOIN labels ON doc_id = file_id WHERE quality = 1 AND parent_id NOT IN (SELECT parent_id FROM kept)""")
def parents_without_children(t: Tables) -> DataFrame:
    """Approved parents whose children went with the toxic files: a look-up of their children is refused."""
    gone = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("file_id"))
    good = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("file_id"))
    kept = t.children().join(gone, "file_id", "left_anti")
    return registry_ops.children_of(t.parents().join(good, "file_id", "left_semi"), kept)[1]


@query("reindex_last_write", f"""WITH {PARENTS_SQL}, writes AS (SELECT parent_id, text, 0 AS version FROM parents
  UNION ALL SELECT parent_id, text || ' (second write)', 1 FROM parents JOIN labels ON doc_id = file_id WHERE quality = 1)
SELECT parent_id, max_by(text, version) AS text, max(version) AS version FROM writes GROUP BY parent_id""")
def reindex_last_write(t: Tables) -> DataFrame:
    """Approved files are indexed a second time; the second write wins."""
    first = t.parents().select("parent_id", "file_id", "text", F.lit(0).alias("version"))
    good = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("file_id"))
    second = first.join(good, "file_id").select("parent_id", "file_id", F.concat("text", F.lit(" (second write)")).alias("text"), F.lit(1).alias("version"))
    return registry_ops.latest(first.unionByName(second).drop("file_id"), ["parent_id"], ["version"])


@query("scope_check", f"""WITH {PARENTS_SQL}, n AS (SELECT file_id, count(*) AS parents FROM parents WHERE trim(text) <> '' GROUP BY 1)
SELECT source AS scope_id, count(*) FILTER (coalesce(parents, 0) > 0) AS usable_files, count(*) FILTER (coalesce(parents, 0) > 0) = 0 AS rejected
FROM documents LEFT JOIN n ON n.file_id = doc_id GROUP BY source""")
def scope_check(t: Tables) -> DataFrame:
    """Files without chunks leave a scope; a scope without files is refused."""
    filled = t.parents().where(F.trim("text") != "").groupBy("file_id").agg(F.count("*").alias("parents"))
    scopes = t.documents.select(F.col("source").alias("scope_id"), F.col("doc_id").alias("file_id")).join(filled, "file_id", "left")
    usable = F.count_if(F.coalesce("parents", F.lit(0)) > 0)
    return scopes.groupBy("scope_id").agg(usable.alias("usable_files"), (usable == 0).alias("rejected"))
