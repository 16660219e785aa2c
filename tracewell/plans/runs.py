"""Queries over whole runs and raw tasks: every code of every rule, by faults put in by number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, schemas, tasks, trajectories
from ..sources import loaders
from . import views as v

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- events: a trajectory's user number modulo 20 says what is wrong with it; the text is SQL of both engines

FAULTY_LOG = """ev AS (
  SELECT user_id AS traj, user_id % 20 AS m, event_id, k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events_k
), c AS (
  SELECT traj, m, event_id, k, n, n % 7 = 3 AS hit, CASE k % 3 WHEN 0 THEN 'glob' WHEN 1 THEN 'grep' ELSE 'read_file' END AS tool FROM ev WHERE event_type IN ('click', 'view')
), named AS (
  SELECT *, CASE WHEN m = 17 AND hit THEN '' WHEN m = 15 AND hit THEN 'same' ELSE concat('c', event_id) END AS id FROM c
), lst AS (
  SELECT traj, max(m) AS m, max(n) + 1 AS n, max(CASE WHEN event_type IN ('click', 'view') THEN n END) AS call FROM ev GROUP BY traj
), fin AS (
  SELECT traj, m, n, call, concat('f', traj) AS id FROM lst WHERE m <> 8 UNION ALL SELECT traj, m, n + 1, call, concat('g', traj) FROM lst WHERE m = 9
), log AS (
  SELECT traj, 4 * n AS seq, CASE WHEN m = 14 AND hit THEN NULL ELSE 'ActionEvent' END AS kind, CASE WHEN m = 19 AND hit THEN 'shell' ELSE tool END AS tool_name, id AS tool_call_id, concat('r', n) AS llm_response_id, CAST(NULL AS INT) AS text_chars, CAST(NULL AS BOOLEAN) AS is_error,
    CASE tool WHEN 'glob' THEN concat('{"pattern":"', CASE WHEN m = 18 AND hit THEN '' ELSE 'p' END, '","path":"d"}') WHEN 'grep' THEN concat('{"pattern":"', CASE WHEN m = 18 AND hit THEN '' ELSE 'x' END, '","include":null}') ELSE concat('{"path":"f","start_line":', CASE WHEN m = 18 AND hit THEN 0 ELSE k + 1 END, '}') END AS action FROM named
  UNION ALL SELECT traj, 4 * n + CASE WHEN m = 5 AND hit THEN -1 ELSE 1 END, 'ObservationEvent', CASE WHEN m = 4 AND hit THEN 'other' ELSE tool END, id, NULL, CASE WHEN m = 16 AND hit THEN NULL ELSE 5 END, CASE WHEN m = 16 AND hit THEN NULL ELSE m = 3 AND hit END, NULL FROM named WHERE NOT (m = 1 AND hit)
  UNION ALL SELECT traj, 4 * n + 2, 'ObservationEvent', tool, id, NULL, 5, FALSE, NULL FROM named WHERE m = 2 AND hit
  UNION ALL SELECT traj, 4 * n, CASE WHEN m = 6 THEN 'ObservationEvent' WHEN m = 7 THEN 'AgentErrorEvent' ELSE 'TokenEvent' END, NULL, concat('z', event_id), NULL, 1, FALSE, NULL FROM ev WHERE event_type NOT IN ('click', 'view')
  UNION ALL SELECT traj, CASE WHEN m = 12 THEN -8 ELSE 4 * n END, 'ActionEvent', 'localization_finish', id, CASE WHEN m = 10 THEN concat('r', call) ELSE concat('end', id) END, NULL, NULL, CASE m WHEN 11 THEN '{"locations":[]}' WHEN 13 THEN '{"locations":[{"file":"../x"}]}' ELSE '{"locations":[{"file":"a.py","class_name":"A"}]}' END FROM fin
  UNION ALL SELECT traj, CASE WHEN m = 12 THEN -7 ELSE 4 * n + 1 END, 'ObservationEvent', 'localization_finish', id, NULL, 5, FALSE, NULL FROM fin
)"""


def faulty_log(spark: SparkSession, d: str) -> DataFrame:
    name = f"events_{uuid.uuid4().hex}"
    v.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).createOrReplaceTempView(name)
    # The log reads its numbered events five times: they are sorted once and written, and no task of the log holds a sort of them.
    first, rest = FAULTY_LOG.split("), c AS (", 1)
    path, numbered = loaders.shared_folder(spark), f"{name}_n"
    try:
        spark.sql(f"WITH {first.replace('FROM events_k', f'FROM {name}')}) SELECT * FROM ev").write.parquet(path)
        spark.read.parquet(path).createOrReplaceTempView(numbered)
        return spark.sql(f"WITH c AS ({rest.replace('FROM ev ', f'FROM {numbered} ')} SELECT * FROM log")
    finally:
        spark.catalog.dropTempView(name)
        spark.catalog.dropTempView(numbered)


_BAD_ACTION = """tool_name NOT IN ('glob', 'grep', 'read_file', 'localization_finish') OR (tool_name IN ('glob', 'grep') AND json_extract_string(action, '$.pattern') = '') OR (tool_name = 'read_file' AND json_extract_string(action, '$.start_line')::INT < 1)
  OR (tool_name = 'localization_finish' AND (json_array_length(action, '$.locations') = 0 OR json_extract_string(action, '$.locations[0].file') LIKE '../%'))"""


def judged_log(spark: SparkSession, d: str) -> DataFrame:
    """faulty_log with what its actions' schemas say."""
    log = faulty_log(spark, d).withColumn("action", F.try_parse_json("action"))
    return log.withColumns({"action_valid": schemas.action_valid(F.col("tool_name"), F.col("action")), "n_locations": F.coalesce(F.size(schemas.locations(F.col("action"))), F.lit(0))})


@query(f"""WITH events_k AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events), {FAULTY_LOG},
a AS (SELECT *, count(*) OVER (PARTITION BY traj, llm_response_id) AS mates, max(seq) OVER (PARTITION BY traj) AS final FROM log WHERE kind = 'ActionEvent'),
o AS (SELECT traj, tool_call_id, count(*) AS n, bool_or(is_error) AS failed, min(seq) AS oseq, min(tool_name) AS otool FROM log WHERE kind = 'ObservationEvent' GROUP BY 1, 2),
f AS (SELECT traj, count(*) AS n, bool_and(mates = 1 AND seq = final) AS ok, bool_or(json_array_length(action, '$.locations') = 0) AS empty FROM a WHERE tool_name = 'localization_finish' GROUP BY traj),
t AS (SELECT traj, CASE WHEN bool_or(kind IS NULL) THEN 'invalid_events' WHEN bool_or(kind = 'ObservationEvent' AND text_chars IS NULL AND is_error IS NULL) THEN 'invalid_observation'
  WHEN bool_or(kind = 'ActionEvent' AND coalesce(tool_call_id, '') = '') OR count(*) FILTER (WHERE kind = 'ActionEvent') <> count(DISTINCT tool_call_id) FILTER (WHERE kind = 'ActionEvent') THEN 'invalid_tool_call_ids' END AS early FROM log GROUP BY traj),
x AS (SELECT a.traj, CASE WHEN n IS DISTINCT FROM 1 THEN 'unpaired_action' WHEN failed THEN 'tool_error' WHEN otool IS DISTINCT FROM tool_name OR oseq <= seq THEN 'observation_mismatch' END AS code FROM a LEFT JOIN o USING (traj, tool_call_id)
  UNION SELECT traj, 'orphan_observation' FROM o ANTI JOIN a USING (traj, tool_call_id) UNION SELECT traj, 'agent_error' FROM log WHERE kind = 'AgentErrorEvent' UNION SELECT traj, 'invalid_action' FROM a WHERE {_BAD_ACTION}
  UNION SELECT t.traj, CASE WHEN coalesce(n, 0) <> 1 THEN 'missing_or_multiple_finish' WHEN NOT ok THEN 'finish_not_sole_final_call' WHEN empty THEN 'empty_finish' END FROM t LEFT JOIN f USING (traj)),
g AS (SELECT traj, string_agg(code, ',' ORDER BY code) AS codes FROM x WHERE code IS NOT NULL GROUP BY traj)
SELECT t.traj, coalesce(early, codes, '') AS codes FROM t LEFT JOIN g USING (traj)""")
def event_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every code of event validation, action schemas included."""
    return events.validate(judged_log(spark, d)).select("traj", F.array_join("codes", ",").alias("codes"))


# --- whole runs: a grep, a finish, and a chat of both; the document number modulo 26 says what is wrong

_RUN_CODES = """(VALUES (1, 'failed_run'), (2, 'failed_run'), (3, 'finish_payload_mismatch'), (4, 'invalid_token_trace'), (5, 'invalid_tool_arguments'), (6, 'invalid_chat_role'), (7, 'invalid_chat_tool_calls'), (8, 'invalid_chat_tool_ids'), (9, 'invalid_chat_tool_ids'),
 (10, 'incomplete_chat_trace,missing_tool_result'), (11, 'orphan_chat_tool_result'), (12, 'incomplete_chat_trace'), (13, 'chat_event_mismatch'), (14, 'chat_action_mismatch'), (15, 'chat_action_mismatch'), (16, 'invalid_final_chat_turn'), (17, 'chat_finish_mismatch'), (18, 'invalid_chat_trace'),
 (19, 'missing_or_multiple_finish'), (23, 'chat_event_mismatch,incomplete_chat_trace,invalid_final_chat_turn'), (24, 'failed_run,invalid_token_trace'))"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = v.table(spark, d, "documents").select(F.col("doc_id").alias("traj"), (F.col("doc_id") % 26).alias("f"))
    message = "named_struct('role', '{}', 'tool_calls', {}, 'tool_call_id', {})".format
    calls = "array(named_struct('id', {}, 'function', named_struct('name', {}, 'arguments', {})))".format
    none = "cast(null AS array<struct<id:string,function:struct<name:string,arguments:string>>>)"
    text = "cast(null AS string)"
    grep = """CASE f WHEN 5 THEN '[1]' WHEN 14 THEN '{"pattern":"other"}' WHEN 20 THEN '{"path":null,"pattern":"add"}' ELSE '{"pattern":"add"}' END"""
    end = """CASE f WHEN 17 THEN '{"locations":[{"file":"c.py"}]}' WHEN 21 THEN '{"locations":[{"file":"a.py","class_name":null}]}' ELSE '{"locations":[{"file":"a.py"}]}' END"""
    first = f"CASE WHEN f = 7 THEN array(cast(null AS struct<id:string,function:struct<name:string,arguments:string>>)) ELSE {calls('CASE f WHEN 8 THEN '+chr(39)*2+' WHEN 13 THEN '+repr('q0')+' ELSE '+repr('c0')+' END', 'CASE f WHEN 15 THEN '+repr('glob')+' ELSE '+repr('grep')+' END', grep)} END"
    second = calls("CASE f WHEN 9 THEN 'c0' ELSE 'c1' END", "'localization_finish'", end)
    answer = "CASE f WHEN 13 THEN 'q0' ELSE 'c0' END"
    chat = f"""CASE WHEN f = 23 THEN array({message('user', none, text)}) ELSE concat(
      array({message('system', none, text)}, {message('user', none, text)}, {message('assistant', first, text)}),
      CASE WHEN f = 10 THEN cast(array() AS {trajectories.CHAT}) ELSE array({message('tool', none, answer)}) END,
      CASE f WHEN 6 THEN array({message('critic', none, text)}) WHEN 11 THEN array({message('tool', none, "'zz'")}) WHEN 18 THEN array(cast(null AS {trajectories.CHAT[6:-1]})) ELSE cast(array() AS {trajectories.CHAT}) END,
      array({message('assistant', second, text)}, {message('tool', none, "'c1'")}),
      CASE WHEN f = 16 THEN array({message('assistant', none, text)}) ELSE cast(array() AS {trajectories.CHAT}) END) END"""
    turns = "array(named_struct('prompt', array(1L, 2L), 'response', array(3L)), named_struct('prompt', array(1L, 2L, CASE WHEN f IN (4, 24) THEN 9L ELSE 3L END, 4L), 'response', array(5L, 6L)))"
    place = "array(named_struct('file', CASE WHEN f = 3 THEN 'b.py' ELSE 'a.py' END, 'class_name', cast(null AS string), 'function_name', cast(null AS string)))"
    runs = base.select(
        "traj", F.expr("CASE WHEN f IN (1, 24) THEN 'error' WHEN f % 2 = 0 THEN 'ok' ELSE 'stop' END").alias("status"), F.expr("CASE WHEN f = 2 THEN array('x') ELSE cast(array() AS array<string>) END").alias("errors"),
        F.expr(place).alias("structured_locations"), F.expr(turns).alias("turns"), F.expr(chat).alias("chat"), F.expr("CASE WHEN f = 12 THEN 0 ELSE 4 END").alias("n_tools"),
    )
    event = "named_struct('seq', {}, 'kind', '{}', 'tool_name', {}, 'tool_call_id', {}, 'llm_response_id', {}, 'text_chars', {}, 'is_error', {}, 'action', {})".format
    rows = [event(1, "ActionEvent", "'grep'", "'c0'", "'r0'", "cast(null AS int)", "cast(null AS boolean)", """'{"kind":"GrepAction","pattern":"add"}'"""), event(2, "ObservationEvent", "'grep'", "'c0'", text, 5, "false", text)]
    ends = [event(3, "ActionEvent", "'localization_finish'", "'c1'", "'r1'", "cast(null AS int)", "cast(null AS boolean)", """'{"kind":"LocalizationFinishAction","locations":[{"file":"a.py"}]}'"""), event(4, "ObservationEvent", "'localization_finish'", "'c1'", text, 5, "false", text)]
    log = base.select("traj", F.explode(F.expr(f"CASE WHEN f = 19 THEN array({', '.join(rows)}) ELSE array({', '.join(rows + ends)}) END")).alias("e")).select("traj", "e.*")
    return runs, log.withColumn("action", F.try_parse_json("action"))


@query(f"SELECT doc_id AS traj, coalesce(codes, '') AS codes FROM documents LEFT JOIN {_RUN_CODES} t(f, codes) ON doc_id % 26 = f")
def run_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every code of a whole run's validation."""
    return trajectories.validate(*_runs(spark, d)).select("traj", F.array_join("codes", ",").alias("codes"))


# --- raw tasks as JSON: the document number modulo 26 says what is wrong

_TASK_CODES = """(VALUES (1, 'invalid_task_object'), (2, 'empty_instance_id'), (3, 'empty_repo'), (4, 'empty_problem_statement'), (5, 'invalid_repo'), (6, 'invalid_repo'), (7, 'invalid_instance_id'), (8, 'base_commit_must_be_immutable'), (9, 'use_patch_must_be_boolean'),
 (10, 'missing_targets'), (11, 'missing_targets'), (12, 'invalid_target_path'), (13, 'invalid_target_details'), (14, 'unknown_target_field'), (15, 'invalid_symbol_list'), (16, 'invalid_symbol_target'), (17, 'duplicate_target_file'), (18, 'invalid_mutation_patch'),
 (19, 'target_patch_mismatch'), (20, 'invalid_patch'), (22, 'invalid_symbol_target'), (24, 'invalid_symbol_target'), (25, 'missing_file_key'))"""


def raw_tasks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, v): a task as a VARIANT."""
    change = r"""CASE f WHEN 12 THEN '{"file":"../x","changes":{}}' WHEN 13 THEN '{"file":"a.py","changes":"bad"}' WHEN 14 THEN '{"file":"a.py","changes":{"x":[]}}' WHEN 15 THEN '{"file":"a.py","changes":{"edited_entities":"a"}}' WHEN 16 THEN '{"file":"a.py","changes":{"edited_entities":["b.py:f"]}}'
      WHEN 17 THEN '{"file":"a.py"},{"file":"a.py"}' WHEN 22 THEN '{"file":"a.py","changes":{"edited_entities":[5]}}' WHEN 23 THEN '{"file":"a.py","changes":null}' WHEN 24 THEN '{"file":"a.py","changes":{"added_modules":["a.py:"]}}' WHEN 25 THEN '{"changes":{}}' ELSE '{"file":"a.py","changes":{"edited_entities":["a.py:f"],"added_modules":null}}' END"""
    patch = r"""CASE f WHEN 18 THEN '--- /dev/null\\n+++ b/a.py\\n@@ -0,0 +1,1 @@\\n+x\\n' WHEN 19 THEN '--- a/b.py\\n+++ b/b.py\\n@@ -1,1 +1,1 @@\\n-x\\n+y\\n' WHEN 20 THEN '--- a/a.py\\n+++ b/a.py\\n@@ -1,9 +1,1 @@\\n-x\\n' ELSE '--- a/a.py\\n+++ b/a.py\\n@@ -1,1 +1,1 @@\\n-x\\n+y\\n' END"""
    part = lambda name, value: f"""concat('"{name}":', {value})"""
    fields = [
        part("problem_statement", r"""CASE WHEN f = 4 THEN '" \\n\\u00a0"' ELSE '" fix "' END"""), part("repo", """CASE f WHEN 3 THEN '5' WHEN 5 THEN '"bad repo"' WHEN 6 THEN '"org/.."' ELSE '"org/src"' END"""), part("base_commit", """CASE WHEN f = 8 THEN '"abc"' ELSE concat('"', repeat('a', 40), '"') END"""),
        part("patch", f"""concat('"', {patch}, '"')"""), part("use_patch", """CASE WHEN f = 9 THEN '"false"' WHEN f IN (18, 19, 20, 21) THEN 'true' ELSE 'false' END"""),
    ]
    some = [f"""CASE f WHEN 2 THEN '"x":1' WHEN 7 THEN '"instance_id":"a b"' ELSE concat('"instance_id":"i-', doc_id, '"') END""", f"""CASE f WHEN 11 THEN '"y":1' WHEN 10 THEN '"file_changes":[]' ELSE concat('"file_changes":[', {change}, ']') END"""]
    text = f"CASE WHEN f = 1 THEN '[1]' ELSE concat('{{', {', '.join(x for f in [*fields, *some] for x in (f, repr(',')))[:-5]}, '}}') END"
    return v.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 26).alias("f")).select("doc_id", F.parse_json(F.expr(text)).alias("v"))


@query(f"SELECT doc_id, code FROM documents LEFT JOIN {_TASK_CODES} t(f, code) ON doc_id % 26 = f")
def task_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that raw tasks can break."""
    rows = tasks.with_patch_files(tasks.from_variant(raw_tasks(spark, d)), "doc_id")
    return rows.select("doc_id", tasks.first_error(rows).alias("code"))


@query(f"""SELECT 'i-' || doc_id AS instance_id, 'fix' AS problem_statement, 'easy' AS difficulty, 'fix' AS prompt, 'a.py' AS target FROM documents LEFT JOIN {_TASK_CODES} t(f, code) ON doc_id % 26 = f WHERE code IS NULL
QUALIFY row_number() OVER (PARTITION BY doc_id % 26 = 21 ORDER BY doc_id) = 1""")
def cleaned_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What cleaning keeps of raw tasks: one of the equal tasks that use their patch and one of those that don't."""
    rows = tasks.with_patch_files(tasks.from_variant(raw_tasks(spark, d)), "doc_id")
    kept, _ = tasks.clean(rows, "doc_id")
    return kept.select("instance_id", "problem_statement", "difficulty", F.col("prompt")[0]["content"].alias("prompt"), F.col("target")[0]["file"].alias("target"))
