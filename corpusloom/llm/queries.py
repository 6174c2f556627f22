"""The registered query of each operator, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of 35-word windows that stand anywhere else too."""
    from corpusloom.llm.recompression import repeated_spans_removed

    rows = repeated_spans_removed(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_importance_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its log importance weight and whether the Gumbel top-k sample holds it."""
    from corpusloom.llm.importance import weighed

    return weighed(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_licence_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the licences that its sentences name, by ordered rules over sentence identifiers."""
    from corpusloom.llm.license_rules import scanned

    return scanned(table(spark, folder, "documents"))


@query(
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
    pages AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
    bad AS (
      SELECT x.source, x.line FROM (
        SELECT source, line, count(DISTINCT r) AS n
        FROM (SELECT source, r, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM d)
        WHERE line <> '' GROUP BY 1, 2) x
      JOIN pages p ON p.source IS NOT DISTINCT FROM x.source WHERE x.n >= 3 AND x.n > 0.1 * p.pages),
    each AS (
      SELECT d.r, d.doc_id, g.i, d.lines[g.i] AS line, b.line IS NOT NULL AS gone
      FROM d, LATERAL (SELECT unnest(range(1, len(d.lines) + 1)) AS i) g
      LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM d.source
        AND b.line = trim(d.lines[g.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))
    SELECT d.doc_id, coalesce(len(d.lines), 0) AS n_lines, coalesce(e.n, 0) AS n_dropped,
           CASE WHEN d.lines IS NOT NULL THEN sha256(coalesce(e.kept, '')) END AS kept_sha256
    FROM d LEFT JOIN (
      SELECT r, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM each GROUP BY r) e
      ON e.r = d.r
    """
)
def op4_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that more than a tenth of its source's documents hold."""
    from corpusloom.llm.site_lines import without_boilerplate

    rows = without_boilerplate(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mix with source weights 1, 2, 3, ... takes."""
    from corpusloom.llm.mixture import taken

    return taken(table(spark, folder, "documents"))


@query()
def op6_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of 5-word shingles and the smallest document that near-duplicate links reach."""
    from corpusloom.llm.jaccard import joined

    return joined(table(spark, folder, "documents"))


@query(
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
    l AS (SELECT conv_id, max(i) AS last FROM n WHERE role = 'assistant' GROUP BY 1),
    a AS (SELECT n.conv_id, last, text AS answer FROM n JOIN l ON l.conv_id = n.conv_id AND i = last),
    p AS (SELECT a.conv_id, a.last, a.answer, b.answer AS other, a.last - (a.answer <> b.answer)::INTEGER AS same
      FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1)),
    r AS (SELECT p.conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
      FROM p JOIN n ON n.conv_id = p.conv_id AND i <= same GROUP BY 1)
    SELECT conv_id, same::BIGINT AS n_prompt_turns, coalesce(prompt, '') AS prompt,
      CASE WHEN same < last THEN '<|assistant|>' || chr(10) || answer || '<|end|>' || chr(10) ELSE '' END AS chosen,
      CASE WHEN same < last THEN '14-' || (22 + length(answer)) ELSE '' END AS chosen_mask,
      CASE WHEN same < last THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected,
      CASE WHEN same < last THEN '14-' || (22 + length(other)) ELSE '' END AS rejected_mask
    FROM p LEFT JOIN r USING (conv_id)
    """
)
def op7_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations whose neighbour has an answer, beside the same with that last answer: common prompt, completions, loss spans."""
    from corpusloom.llm.preference import formatted, neighbour_pairs

    rows = formatted(neighbour_pairs(table(spark, folder, "conversations"))).withColumnRenamed("key", "conv_id")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rows.withColumns({c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


@query()
def op8_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged by the base rules and by cutoffs with a bounded false rejection per language."""
    from corpusloom.llm.risk_rules import judged

    rows = judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


@query()
def op9_edited_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits, and how much of it the edits encoded."""
    from corpusloom.llm.edit_tokens import counted, sample_edits

    docs = table(spark, folder, "documents")
    edits = sample_edits(F.col("text"), F.col("source"), F.col("n_chars"))
    rows = counted(docs.withColumn("edits", edits))
    return rows.select("doc_id", "n_tokens", "n_tokens_after", "n_pieces", "n_encoded", F.sha2("edited_text", 256).alias("edited_sha256"))


def _item_words(text: str) -> str:
    """SQL for the words of ``decontaminate.item_words``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = rf"string_split_regex(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"list_filter({split}, lambda x: x <> '')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_item_words('text')} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_item_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
    each AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
    h AS (SELECT r, i, n, item_id FROM each JOIN g USING (n, gram)),
    p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY 1),
    t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
    """
)
def op10_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words inside benchmark windows and a digest of the items found."""
    from corpusloom.llm.decontaminate import hits

    rows = hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of tokens, a digest of their ids, and a digest of the bytes these ids decode to."""
    import public_tokenizers

    from corpusloom.llm.byte_bpe import VOCABULARY, read_ranks, round_trip

    rows = round_trip(table(spark, folder, "documents"), read_ranks(public_tokenizers.path(VOCABULARY)))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def _leaf_sql(text: str) -> str:
    each = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(each)})"


def _tree_sql(name: str, leaves: str, by: str) -> str:
    """Recursive SQL for all nodes of trees over ``leaves`` (by, i, n, h), and for each the digests beside it in its run."""
    run = f"OVER (PARTITION BY {by}, level, i // 16 ORDER BY i ROWS BETWEEN"
    return f"""
    {name}({by}, level, i, n, h) AS (
      SELECT {by}, 0, i, n, h FROM {leaves} UNION ALL
      SELECT {by}, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {by}, level, i // 16, n),
    {name}_run AS (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    f"""
    WITH RECURSIVE crc AS (
      SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
      FROM (SELECT unnest(range(256)) AS b)),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS s, {_leaf_sql('text')} AS h,
      CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 5 = 0
        THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} ELSE {_leaf_sql('text')} END AS shown
      FROM documents, crc),
    lv AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
    {_tree_sql('t', 'lv', 's')},
    tops AS (SELECT 0 AS z, s, h, row_number() OVER (ORDER BY encode(s)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    {_tree_sql('u', 'tops', 'z')},
    way AS (
      SELECT lv.r, level, 0 AS part, t_run.l, t_run.r AS rr FROM lv JOIN t_run ON t_run.s = lv.s AND t_run.i = lv.i // (16 ** level)::BIGINT
      UNION ALL
      SELECT lv.r, level, 1, u_run.l, u_run.r FROM lv JOIN tops ON tops.s = lv.s JOIN u_run ON u_run.i = tops.i // (16 ** level)::BIGINT),
    steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY part, level) AS k FROM way),
    up(r, k, h) AS (
      SELECT r, 0, shown FROM lv UNION ALL
      SELECT up.r, up.k + 1, sha256(steps.l || up.h || steps.rr) FROM up JOIN steps ON steps.r = up.r AND steps.k = up.k + 1)
    SELECT lv.doc_id, lv.h AS leaf, tops.h AS subroot, root.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
    FROM lv JOIN tops ON tops.s = lv.s, (SELECT h FROM u WHERE n = 1) root
    LEFT JOIN (SELECT r, string_agg(l || rr, '' ORDER BY k) AS proof FROM steps GROUP BY 1) p ON p.r = lv.r
    JOIN (SELECT r, arg_max(h, k) AS h FROM up GROUP BY 1) e ON e.r = lv.r
    """
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its leaf, the roots, its proof's digest, and the root that its own or a changed leaf gives."""
    from corpusloom.llm.columns import ascii_lower
    from corpusloom.llm.merkle import leaf_digest, proofs

    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    shown = F.when(changed, leaf_digest([*fields, ascii_lower(F.col("text"))]))
    rows = proofs(table(spark, folder, "documents"), leaf_digest([*fields, F.col("text")]), shown)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _codes_sql(rounds: int) -> str:
    """Recursion written out: (p, e, y) are the entries of each part after a round, (r, p, e, dist) the nearest ones."""
    def near(k: int) -> str:
        return f"""
    n{k} AS (SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
      SELECT r, x.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT AS dist
      FROM x JOIN c{k} USING (p)) GROUP BY r, p)"""

    def better(k: int) -> str:
        return f"""
    c{k + 1} AS (SELECT p, e, coalesce(m.y, c{k}.y) AS y FROM c{k} LEFT JOIN (
      SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y
      FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM x JOIN n{k} USING (r, p))
        GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""

    steps = ",".join(near(k) + "," + better(k) for k in range(rounds)) + "," + near(rounds)
    return f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS (SELECT r, p, w[p * len(w) // 8 + 1:(p + 1) * len(w) // 8] AS x FROM v, (SELECT unnest(range(8)) AS p)),
    c0 AS (SELECT p, r - 1 AS e, x AS y FROM x WHERE r <= 16),{steps},
    book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS digest FROM c{rounds}),
    coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM n{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
    FROM v JOIN coded USING (r), book
    """


@query(_codes_sql(6))
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's code, its squared error, the error of all vectors of its label, and a digest of the codebooks."""
    from corpusloom.llm.vector_codes import compressed

    rows, books = compressed(table(spark, folder, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
