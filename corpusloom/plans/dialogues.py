"""Registered queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import querytype as Q
from corpusloom.operators import dialogues as D
from corpusloom.operators import online, registry_ops
from corpusloom.plans.registry import PARENTS_SQL, Tables, query

# The table has no document ids and no tool turns. Answers cite parents named after their conversation and turn
# (some of which do not exist, short answers cite none), and every user turn is followed by a tool turn.
CITED_SQL = """CASE WHEN role = 'assistant' AND length(text) >= 150 THEN
  [conv_id || ':0', turn || ':' || turn, conv_id || ':' || turn, conv_id || ':0'] ELSE [] END"""
TURNS_SQL = f"""turns AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'ai' ELSE role END AS role, text, {CITED_SQL} AS parent_doc_ids FROM conversations)"""
TOOLS_SQL = TURNS_SQL + """,
tool_turns AS (SELECT conv_id, turn * 2 AS turn, role, text FROM turns
  UNION ALL SELECT conv_id, turn * 2 + 1, 'tool', 'looked up: ' || text FROM turns WHERE role = 'user'),
in_rounds AS (SELECT * FROM (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS round FROM tool_turns WHERE role <> 'system') WHERE round > 0),
counted AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS round_count FROM in_rounds)"""
PAIRS_SQL = TURNS_SQL + f""", {PARENTS_SQL},
talk AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER w AS user_turn FROM turns WHERE role IN ('user', 'ai')
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
raw_pairs AS (SELECT a.conv_id, a.user_turn, a.turn AS ai_turn, u.text AS user_input, a.text AS answer, a.parent_doc_ids
  FROM (SELECT * FROM talk WHERE role = 'ai' AND user_turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, user_turn ORDER BY turn) = 1) a
  JOIN turns u ON u.conv_id = a.conv_id AND u.turn = a.user_turn),
cites AS (SELECT conv_id, ai_turn, parent_doc_ids[i] AS parent_id, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(parent_doc_ids) + 1)) AS i FROM raw_pairs)),
cited AS (SELECT conv_id, ai_turn, pos, c.parent_id, file_id::VARCHAR AS file_id, p.text FROM cites c JOIN parents p ON p.parent_id = c.parent_id),
file_lists AS (SELECT conv_id, ai_turn, list(file_id ORDER BY first_pos) AS scope_file_ids FROM (
  SELECT conv_id, ai_turn, file_id, min(pos) AS first_pos FROM cited GROUP BY ALL) GROUP BY ALL),
text_lists AS (SELECT conv_id, ai_turn, list(text ORDER BY pos) FILTER (text <> '') AS reference_contexts FROM cited GROUP BY ALL),
pairs AS (SELECT r.*, scope_file_ids, reference_contexts FROM raw_pairs r JOIN file_lists USING (conv_id, ai_turn) JOIN text_lists USING (conv_id, ai_turn))"""


def turns(t: Tables) -> DataFrame:
    own = F.col("conv_id").cast("string")
    turn = F.col("turn").cast("string")
    cited = F.array(F.concat(own, F.lit(":0")), F.concat(turn, F.lit(":"), turn), F.concat(own, F.lit(":"), turn), F.concat(own, F.lit(":0")))
    has = (F.col("role") == "ai") & (F.length("text") >= 150)
    return t.turns().withColumn("parent_doc_ids", F.when(has, cited).otherwise(F.array().cast("array<string>")))


def tool_turns(t: Tables) -> DataFrame:
    said = t.turns().select("conv_id", (F.col("turn") * 2).alias("turn"), "role", "text")
    looked = t.turns().where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") * 2 + 1).alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("looked up: "), "text").alias("text")
    )
    return said.unionByName(looked)


def pairs(t: Tables) -> DataFrame:
    return D.answered_from(D.user_ai_pairs(turns(t)), t.parents())


@query("rounds", f"WITH {TOOLS_SQL} SELECT conv_id, turn, role, round FROM in_rounds")
def rounds(t: Tables) -> DataFrame:
    return D.rounds(tool_turns(t)).select("conv_id", "turn", "role", "round")


@query("compact_old_turns", f"""WITH {TOOLS_SQL} SELECT conv_id, turn, role, round, round <= round_count - 3 AND role = 'tool' AS replaced,
  CASE WHEN round <= round_count - 3 AND role = 'tool' THEN '{D.PLACEHOLDER}' ELSE text END AS text FROM counted""")
def compact_old_turns(t: Tables) -> DataFrame:
    return D.compact_tool_turns(tool_turns(t)).select("conv_id", "turn", "role", "round", "replaced", "text")


@query("summary_split", f"WITH {TOOLS_SQL} SELECT conv_id, turn, round, round_count, round_count > 2 AND round <= round_count - 1 AS to_summarize FROM counted")
def summary_split(t: Tables) -> DataFrame:
    rows = D.summary_split(tool_turns(t), threshold=2, rounds_to_keep=1)
    return rows.select("conv_id", "turn", "round", "round_count", "to_summarize")


@query("user_ai_pairs", f"""WITH {PAIRS_SQL} SELECT conv_id, user_turn, ai_turn, user_input, answer, array_to_string(parent_doc_ids, '|') AS parent_doc_ids,
  array_to_string(scope_file_ids, '|') AS scope_file_ids, array_to_string(reference_contexts, '|') AS reference_contexts FROM pairs""")
def user_ai_pairs(t: Tables) -> DataFrame:
    return pairs(t).select(
        "conv_id", "user_turn", "ai_turn", "user_input", "answer",
        *[F.array_join(c, "|").alias(c) for c in ("parent_doc_ids", "scope_file_ids", "reference_contexts")],
    )


@query("last_answer", """SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def last_answer(t: Tables) -> DataFrame:
    return D.latest_by_role(t.turns(), "ai")


@query("last_tool_context", f"WITH {TOOLS_SQL} SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM tool_turns WHERE role = 'tool' GROUP BY conv_id")
def last_tool_context(t: Tables) -> DataFrame:
    return D.latest_by_role(tool_turns(t), "tool")


@query("carried_question", """WITH q AS (SELECT conv_id, turn, text, length(text) >= 120 OR turn = min(turn) OVER (PARTITION BY conv_id) AS takes FROM conversations WHERE role = 'user')
SELECT conv_id, turn, last_value(CASE WHEN takes THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS original_question FROM q""")
def carried_question(t: Tables) -> DataFrame:
    """Stand-in verdict: long questions open a new topic."""
    questions = t.turns().where(F.col("role") == "user")
    return D.carried_question(questions, F.length("text") >= 120).select("conv_id", "turn", "original_question")


@query("reference_grouping", f"""WITH {TURNS_SQL}, {PARENTS_SQL},
u AS (SELECT conv_id, turn, parent_doc_ids[i] AS parent_id, i AS pos FROM (SELECT *, unnest(range(1, len(parent_doc_ids) + 1)) AS i FROM turns)),
d AS (SELECT conv_id, turn, parent_id, min(pos) AS pos FROM u GROUP BY ALL), f AS (SELECT d.*, file_id FROM d JOIN parents USING (parent_id))
SELECT conv_id, turn, file_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(pos))::INTEGER AS file_rank, string_agg(parent_id, '|' ORDER BY pos) AS parent_ids FROM f GROUP BY conv_id, turn, file_id""")
def reference_grouping(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    grouped = D.references_by_file(turns(t), t.parents(), ["conv_id", "turn"])
    order = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("first_pos"))
    return grouped.select("conv_id", "turn", "file_id", order.alias("file_rank"), F.array_join("parent_ids", "|").alias("parent_ids"))


@query("get_many_parents", f"""WITH {TURNS_SQL}, {PARENTS_SQL}
SELECT conv_id, turn, pos, parent_id, text FROM (SELECT conv_id, turn, parent_doc_ids[i] AS parent_id, (i - 1)::INTEGER AS pos FROM (
  SELECT *, unnest(range(1, len(parent_doc_ids) + 1)) AS i FROM turns)) JOIN (SELECT parent_id, text FROM parents) USING (parent_id)""")
def get_many_parents(t: Tables) -> DataFrame:
    requests = turns(t).select("conv_id", "turn", "parent_doc_ids")
    rows = registry_ops.get_many(requests, t.parents().select("parent_id", "text"), "parent_doc_ids", "parent_id")
    return rows.select("conv_id", "turn", "pos", "parent_id", "text")


@query("missing_parents", f"""WITH {TURNS_SQL}, {PARENTS_SQL}, u AS (SELECT DISTINCT unnest(parent_doc_ids) AS parent_id FROM turns)
SELECT parent_id FROM u WHERE parent_id NOT IN (SELECT parent_id FROM parents)""")
def missing_parents(t: Tables) -> DataFrame:
    asked = turns(t).select(F.explode("parent_doc_ids").alias("parent_id")).distinct()
    return registry_ops.point_lookup(asked, t.parents().select("parent_id"), "parent_id")[1]


@query("message_rendering", f"""WITH {TOOLS_SQL} SELECT conv_id, turn, CASE role WHEN 'user' THEN 'HumanMessage: ' || text
  WHEN 'tool' THEN 'ToolMessage: ' || substr(text, 1, 100) || '...' WHEN 'ai' THEN 'AIMessage: ' || text END AS line FROM tool_turns""")
def message_rendering(t: Tables) -> DataFrame:
    return tool_turns(t).select("conv_id", "turn", D.rendered(F.col("role"), F.col("text")).alias("line"))


@query("message_records", f"""WITH {TOOLS_SQL} SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE role END AS type, text AS content,
  CASE WHEN role = 'tool' THEN conv_id || '-' || turn END AS tool_call_id, CASE WHEN role = 'tool' THEN 'success' END AS status,
  CASE WHEN role = 'ai' THEN 0 END AS tool_call_count, CASE WHEN role = 'user' THEN 'human' END AS role FROM tool_turns""")
def message_records(t: Tables) -> DataFrame:
    call = F.concat_ws("-", "conv_id", "turn")
    none = F.array().cast("array<string>")
    rows = tool_turns(t).select("conv_id", "turn", D.flattened(F.col("role"), F.col("text"), none, call, F.lit("success")).alias("m"))
    return rows.select("conv_id", "turn", "m.type", "m.content", "m.tool_call_id", "m.status", F.when(F.col("m.tool_calls").isNotNull(), F.size("m.tool_calls")).alias("tool_call_count"), "m.role")


@query("type_heuristic", f"""WITH {PAIRS_SQL}, x AS (SELECT conv_id, ai_turn, lower(trim(user_input)) AS q,
    len(list_distinct(parent_doc_ids)) >= 2 OR len(scope_file_ids) >= 2 AS evidence FROM pairs),
y AS (SELECT *, regexp_matches(q, '\\bwhy\\b|\\bhow\\b|\\bcompare\\b|\\bdifference\\b|\\bsummar|\\boverview\\b|\\bexplain\\b') AS abs,
    regexp_matches(q, '\\bbetween\\b|\\brelationship\\b|\\bimpact\\b|\\bdepend\\b|\\balso\\b') AS worded FROM x)
SELECT conv_id, ai_turn, (CASE WHEN evidence OR worded THEN 'multi' ELSE 'single' END) || '_hop_' || (CASE WHEN abs THEN 'abstract' ELSE 'specific' END) AS query_type,
  round(least(0.55::DOUBLE + evidence::INT * 0.2::DOUBLE + abs::INT * 0.15::DOUBLE + worded::INT * 0.1::DOUBLE, 0.95::DOUBLE), 2) AS confidence,
  concat_ws('|', CASE WHEN abs THEN 'abstract_keyword' END, CASE WHEN evidence THEN 'multi_evidence' END, CASE WHEN worded THEN 'multi_keyword' END) AS reasons FROM y""")
def type_heuristic(t: Tables) -> DataFrame:
    found = Q.detect(F.col("user_input"), F.col("parent_doc_ids"), F.col("scope_file_ids"))
    return pairs(t).select("conv_id", "ai_turn", found["query_type"].alias("query_type"), found["confidence"].alias("confidence"), F.array_join(found["reasons"], "|").alias("reasons"))


@query("conversation_list", """SELECT conv_id, max(turn) AS updated_at, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id""")
def conversation_list(t: Tables) -> DataFrame:
    return t.turns().groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.count("*").alias("turns")).orderBy(F.desc("updated_at"), "conv_id")


@query("turn_history", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def turn_history(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query("delete_conversation", """WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (FROM gone)""")
def delete_conversation(t: Tables) -> DataFrame:
    """Conversations that open with a system turn are deleted with all their turns."""
    doomed = t.turns().where(F.col("role") == "system").select("conv_id")
    return registry_ops.delete_cascade({"turns": t.turns()}, doomed, {"turns": "conv_id"})["turns"].select("conv_id", "turn")


@query("conversation_changes", """WITH created AS (SELECT conv_id, 'untitled' AS title FROM conversations GROUP BY conv_id),
renamed AS (SELECT conv_id, max_by(text, turn) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, coalesce(r.title, c.title) AS title, r.title IS NOT NULL AS renamed FROM created c LEFT JOIN renamed r USING (conv_id)""")
def conversation_changes(t: Tables) -> DataFrame:
    """Each user turn renames its conversation; the last change wins."""
    created = t.turns().select("conv_id").distinct().select("conv_id", F.lit("untitled").alias("title"), F.lit(-1).cast("long").alias("version"))
    changes = t.turns().where(F.col("role") == "user").select("conv_id", F.col("text").alias("title"), F.col("turn").alias("version"))
    merged = online.upsert(created, changes, "conv_id", ["version"])
    return merged.select("conv_id", "title", (F.col("version") >= 0).alias("renamed"))


@query("checkpoint_changes", """SELECT conv_id, CASE WHEN max_by(role, turn) = 'assistant' THEN NULL ELSE 'thread-' || conv_id || '-' || max(turn) END AS checkpoint_id FROM conversations GROUP BY conv_id""")
def checkpoint_changes(t: Tables) -> DataFrame:
    """A question sets the thread's checkpoint id, an answer clears it."""
    changes = t.turns().select(
        "conv_id", "turn", F.when(F.col("role") != "ai", F.concat_ws("-", F.lit("thread"), "conv_id", "turn")).alias("checkpoint_id")
    )
    return registry_ops.latest(changes, ["conv_id"], ["turn"]).select("conv_id", "checkpoint_id")
