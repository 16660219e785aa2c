"""Queries over tasks, labels, trajectories and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, paths, scoring, text, tokens
from ..operators import evaluate, events, tasks
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


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- scans and paths


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").where("lang = 'en' AND n_chars > 1000").select("doc_id", "lang", "n_chars")


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN p = '' THEN '.' ELSE rtrim(regexp_replace(p, '/+', '/', 'g'), '/') END AS path FROM u""")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return v.table(spark, d, "pages").select("page_id", paths.normalized(path).alias("path"))


@query(f"""WITH {v.CODE_FILE}, p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/' || path WHEN 1 THEN './' || path WHEN 2 THEN 'a/../' || path WHEN 3 THEN ' ' || path ELSE path END AS p FROM code_file)
SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN 'invalid_target_path' END AS error, CASE WHEN doc_id % 6 >= 4 THEN p END AS path FROM p""")
def path_validation(spark: SparkSession, d: str) -> DataFrame:
    k, path = F.col("doc_id") % 6, F.col("path")
    p = F.when(k == 0, F.concat(F.lit("/"), path)).when(k == 1, F.concat(F.lit("./"), path)).when(k == 2, F.concat(F.lit("a/../"), path)).when(k == 3, F.concat(F.lit(" "), path)).otherwise(path)
    out = v.code_file(spark, d).withColumn("p", p)
    return out.select("doc_id", paths.path_error(F.col("p")).alias("error"), F.when(paths.path_error(F.col("p")).isNull(), paths.clean_path(F.col("p"))).alias("path"))


# --- tasks


_TASK_REASON = r"""CASE WHEN regexp_replace(problem_statement, '^\s+|\s+$', '', 'g') = '' THEN 'empty_problem_statement'
  WHEN NOT regexp_full_match(repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN 'invalid_repo' END"""


@query(f"WITH {v.TASK_ROW} SELECT ord, {_TASK_REASON} AS reason FROM task_row")
def task_validation_first_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = v.task_row(spark, d)
    return rows.select("ord", tasks.first_error(rows).alias("reason"))


@query(f"WITH {v.TASK_ROW} SELECT {_TASK_REASON} AS reason, count(*) AS n FROM task_row GROUP BY 1")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = v.task_row(spark, d)
    return rows.groupBy(tasks.first_error(rows).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {v.TASK_ROW}, r AS (SELECT ord, {_TASK_REASON} AS reason FROM task_row), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ord) AS i FROM r WHERE reason IS NOT NULL)
SELECT reason, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS examples FROM k WHERE i <= 20 GROUP BY reason""")
def reason_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = v.task_row(spark, d)
    told = rows.select("ord", tasks.first_error(rows).alias("reason")).where("reason IS NOT NULL")
    few = told.withColumn("i", F.row_number().over(Window.partitionBy("reason").orderBy("ord"))).where("i <= 20")
    return few.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("examples"))


_KEY = r"repo || '|' || regexp_replace(trim(regexp_replace(problem_statement, '[\s]+', ' ', 'g')), '^ | $', '', 'g')"


@query(f"WITH {v.TASK_ROW} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) AS i FROM task_row) WHERE i = 1")
def task_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    rows = v.task_row(spark, d).select("ord", text.task_key(F.col("repo"), none("string"), F.col("problem_statement"), none("string"), none("boolean")).alias("key"))
    return rows.groupBy("key").agg(F.min("ord").alias("ord")).select("ord")


_OWN = v.TASK_ROW.replace("(doc_id % 900)", "(doc_id - CASE WHEN doc_id % 50 = 49 THEN 1 ELSE 0 END)")


@query(f"""WITH {_OWN}, g AS (SELECT ord, instance_id, {_KEY} AS k FROM task_row WHERE {_TASK_REASON} IS NULL),
l AS (SELECT list({{'ids': [instance_id], 'keys': [k], 'ords': [ord]}} ORDER BY ord) AS rows FROM g),
r AS (SELECT list_reduce(rows, lambda s, x: CASE WHEN list_contains(s.ids, x.ids[1]) OR list_contains(s.keys, x.keys[1]) THEN s ELSE {{'ids': list_concat(s.ids, x.ids), 'keys': list_concat(s.keys, x.keys), 'ords': list_concat(s.ords, x.ords)}} END) AS s FROM l)
SELECT unnest(s.ords) AS ord, unnest(s.ids) AS instance_id FROM r""")
def two_key_greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = tasks.clean(v.task_row_clashing(spark, d), "ord")
    return kept.select("ord", "instance_id")


_DIFF = f"""WITH {v.SYMBOLS}, g AS (
  SELECT id, count(*) FILTER (WHERE level = 'file') AS files, count(*) FILTER (WHERE level = 'entity') AS entities FROM symbols WHERE truth GROUP BY id
), g2 AS (SELECT id, CASE WHEN files = 1 AND entities <= 1 THEN 'easy' WHEN files <= 3 AND entities <= 5 THEN 'medium' ELSE 'hard' END AS difficulty FROM g)"""


#: Orders without a true symbol have no difficulty.
_KNOWN = "t_file + t_module + t_entity > 0"


def _difficulty(spark: SparkSession, d: str) -> DataFrame:
    return v.symbol_counts(spark, d).where(_KNOWN).select("id", tasks.difficulty(F.col("t_file"), F.col("t_entity")).alias("difficulty"))


@query(_DIFF + " SELECT id, difficulty FROM g2")
def difficulty_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _difficulty(spark, d)


@query(_DIFF + " SELECT difficulty, count(*) AS n FROM g2 GROUP BY 1")
def difficulty_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _difficulty(spark, d).groupBy("difficulty").agg(F.count("*").alias("n"))


_SPLIT = "('0x' || substr(sha256('\"' || lower(repo) || '\"'), 1, 8))::BIGINT / 4294967296.0 < 0.3"


@query(f"WITH {v.TASK_ROW} SELECT ord, CASE WHEN {_SPLIT} THEN 'validation' ELSE 'train' END AS split FROM task_row")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return v.task_row(spark, d).select("ord", tasks.hash_split(F.col("repo"), 0.3).alias("split"))


@query(f"WITH {v.TASK_ROW} SELECT CASE WHEN {_SPLIT} THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM task_row GROUP BY 1")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hash_split(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) <= 100 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    return tasks.sampled_split(v.table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


@query(None)
def shuffled_split(spark: SparkSession, d: str) -> DataFrame:
    return tasks.shuffled_split(v.table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


# --- scores


_F1 = f"""WITH {v.SYMBOLS}, c AS (
  SELECT id, level, count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE predicted) AS np, count(*) FILTER (WHERE truth) AS nt FROM symbols GROUP BY id, level
), f AS (SELECT id, level, CASE WHEN tp > 0 THEN 2 * (tp / np::DOUBLE) * (tp / nt::DOUBLE) / (tp / np::DOUBLE + tp / nt::DOUBLE) ELSE 0 END AS f1 FROM c),
r AS (SELECT id, coalesce(max(f1) FILTER (WHERE level = 'file'), 0) AS file_reward, coalesce(max(f1) FILTER (WHERE level = 'module'), 0) AS module_reward, coalesce(max(f1) FILTER (WHERE level = 'entity'), 0) AS entity_reward FROM f GROUP BY id)"""


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of each order, from its counts of symbols."""
    f1 = lambda x: scoring.f1_of_counts(F.col(f"tp_{x}"), F.col(f"p_{x}"), F.col(f"t_{x}"))
    return v.symbol_counts(spark, d).select("id", *(f1(x).alias(f"{x}_reward") for x in ("file", "module", "entity")), "t_file", "t_module", "t_entity")


@query(_F1 + " SELECT id, round(file_reward, 6) AS file_reward, round(module_reward, 6) AS module_reward, round(entity_reward, 6) AS entity_reward, round(file_reward + module_reward + entity_reward, 6) AS reward FROM r")
def multilevel_f1(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("file_reward") + F.col("module_reward") + F.col("entity_reward")
    rows = _rewards(spark, d).select("id", "file_reward", "module_reward", "entity_reward", total.alias("reward"))
    return rounded(rows, "file_reward", "module_reward", "entity_reward", "reward")


@query(_F1 + ", " + _DIFF[_DIFF.index("g AS (") :] + " SELECT difficulty, round(avg(file_reward + module_reward + entity_reward), 6) AS mean_quality, count(*) AS tasks FROM r JOIN g2 USING (id) GROUP BY 1")
def mean_quality_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("file_reward") + F.col("module_reward") + F.col("entity_reward")
    known = _rewards(spark, d).where(_KNOWN).where("id IS NOT NULL")
    return known.withColumn("difficulty", tasks.difficulty(F.col("t_file"), F.col("t_entity"))).groupBy("difficulty").agg(F.round(F.avg(total), 6).alias("mean_quality"), F.count("*").alias("tasks"))


_METRICS = f"""WITH {v.EVENT_LOG}, m AS (
  SELECT traj, count(*) FILTER (WHERE kind = 'ActionEvent')::DOUBLE AS num_tool_calls,
    count(*) FILTER (WHERE kind = 'ActionEvent' AND tool_name IN ('glob', 'grep'))::DOUBLE AS search_calls,
    count(*) FILTER (WHERE kind = 'ActionEvent' AND tool_name = 'read_file')::DOUBLE AS read_calls,
    sum(CASE WHEN kind = 'ObservationEvent' AND tool_name = 'read_file' THEN end_line - start_line + 1 ELSE 0 END)::DOUBLE AS read_lines,
    sum(CASE WHEN kind = 'ObservationEvent' AND tool_name IS DISTINCT FROM 'localization_finish' THEN text_chars ELSE 0 END)::DOUBLE AS output_chars,
    sum(CASE WHEN kind = 'ObservationEvent' AND tool_name IS DISTINCT FROM 'localization_finish' THEN greatest(0, text_chars - 8000) ELSE 0 END)::DOUBLE AS excess_output_chars,
    count(*) FILTER (WHERE kind = 'ObservationEvent' AND truncated)::DOUBLE AS truncated_outputs, count(*) FILTER (WHERE kind = 'ObservationEvent' AND is_error)::DOUBLE AS tool_errors,
    sum(coalesce(response_tokens, 0))::DOUBLE AS completion_tokens, count(*) FILTER (WHERE kind = 'TokenEvent')::DOUBLE AS num_turns FROM event_log GROUP BY traj
), rs AS (
  SELECT traj, count(*) FILTER (WHERE i > 1)::DOUBLE AS repeated_searches FROM (SELECT traj, row_number() OVER (PARTITION BY traj, tool_name, pattern, path ORDER BY seq) AS i FROM event_log WHERE kind = 'ActionEvent' AND tool_name IN ('glob', 'grep')) GROUP BY traj
), ol AS (
  SELECT traj, count(*) FILTER (WHERE i > 1)::DOUBLE AS overlap_lines FROM (
    SELECT traj, row_number() OVER (PARTITION BY traj, path, line ORDER BY seq) AS i FROM (SELECT traj, path, seq, unnest(range(start_line, end_line + 1)) AS line FROM event_log WHERE kind = 'ObservationEvent' AND tool_name = 'read_file')) GROUP BY traj
), t AS (
  SELECT m.*, coalesce(repeated_searches, 0) AS repeated_searches, coalesce(overlap_lines, 0) AS overlap_lines, coalesce(overlap_lines, 0) / greatest(1, read_lines) AS overlap_ratio
  FROM m LEFT JOIN rs USING (traj) LEFT JOIN ol USING (traj)
), cost AS (
  SELECT *, 0.01 * greatest(0, num_tool_calls - 1) + 0.1 * repeated_searches + 0.2 * overlap_ratio + output_chars / 100000 + excess_output_chars / 50000 + 0.05 * truncated_outputs AS tool_efficiency_cost FROM t
)"""


@query(_METRICS + " SELECT * REPLACE (round(overlap_ratio, 6) AS overlap_ratio, round(tool_efficiency_cost, 6) AS tool_efficiency_cost) FROM cost")
def tool_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.tool_metrics(v.event_log(spark, d)), "overlap_ratio", "tool_efficiency_cost")


@query(_METRICS + " SELECT traj, round(least(q, 0.2 * tool_efficiency_cost), 6) AS penalty, round(q - least(q, 0.2 * tool_efficiency_cost), 6) AS total FROM (SELECT *, (traj % 4)::DOUBLE AS q FROM cost)")
def penalized_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = events.tool_metrics(v.event_log(spark, d)).select("traj", scoring.penalized((F.col("traj") % 4).cast("double"), F.col("tool_efficiency_cost")).alias("p"))
    return rounded(rows.select("traj", "p.penalty", "p.total"), "penalty", "total")


@query(_METRICS + """ SELECT traj, CASE WHEN q < 1 AND c > 3 THEN 'low_quality,high_cost' WHEN q < 1 THEN 'low_quality' WHEN c > 3 THEN 'high_cost' ELSE '' END AS reasons FROM (SELECT traj, (traj % 4)::DOUBLE AS q, tool_efficiency_cost AS c FROM cost)""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import export

    rows = events.tool_metrics(v.event_log(spark, d)).select("traj", (F.col("traj") % 4).cast("double").alias("quality"), F.col("tool_efficiency_cost").alias("cost"))
    return rows.select("traj", F.array_join(export.rejections(F.col("quality"), F.col("cost"), 1.0, 3.0), ",").alias("reasons"))


@query(f"""WITH {v.EVENT_LOG}, s AS (
  SELECT traj, string_agg(tool_name || ' ' || coalesce(pattern, '') || ' ' || path, ';' ORDER BY seq) AS steps FROM event_log WHERE kind = 'ActionEvent' GROUP BY traj), t AS (SELECT traj // 3 * 3 AS twin, traj FROM (SELECT DISTINCT traj FROM event_log))
SELECT min(t.traj) AS traj FROM t LEFT JOIN s ON s.traj = t.twin GROUP BY coalesce(steps, '')""")
def trajectory_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first trajectory of each sequence of all actions; three neighbours have the actions of the first of them."""
    from ..operators import export

    log = v.event_log(spark, d)
    steps = export.action_steps(log)
    twins = log.select("traj").distinct().withColumn("twin", F.floor(F.col("traj") / 3) * 3)
    said = twins.join(steps.withColumnRenamed("traj", "twin"), "twin", "left").select("traj", F.coalesce("steps", F.lit("[]")).alias("steps"))
    return export.first_of_sequence(said, "traj", "steps").select("traj")


# --- event validation


@query(f"""WITH {v.EVENT_LOG}, o AS (SELECT traj, tool_call_id, count(*) AS n, bool_or(is_error) AS failed, min(seq) AS seq, min(tool_name) AS tool FROM event_log WHERE kind = 'ObservationEvent' GROUP BY 1, 2)
SELECT a.traj, a.tool_call_id, a.seq AS action_seq, a.tool_name AS action_tool, CASE WHEN coalesce(n, 0) <> 1 THEN 'unpaired_action' WHEN failed THEN 'tool_error' WHEN tool IS DISTINCT FROM a.tool_name OR o.seq <= a.seq THEN 'observation_mismatch' END AS code
FROM event_log a LEFT JOIN o USING (traj, tool_call_id) WHERE a.kind = 'ActionEvent'""")
def action_observation_pairing(spark: SparkSession, d: str) -> DataFrame:
    return events.pairing(v.event_log(spark, d))


@query(f"""WITH {v.EVENT_LOG} SELECT traj, seq, tool_call_id FROM event_log o WHERE kind = 'ObservationEvent' AND NOT EXISTS (SELECT 1 FROM event_log a WHERE a.kind = 'ActionEvent' AND a.traj = o.traj AND a.tool_call_id = o.tool_call_id)""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return events.orphans(v.event_log(spark, d))


@query(f"""WITH {v.EVENT_LOG}, a AS (SELECT *, count(*) OVER (PARTITION BY traj, llm_response_id) AS mates, max(seq) OVER (PARTITION BY traj) AS last FROM event_log WHERE kind = 'ActionEvent')
SELECT traj, count(*) FILTER (WHERE tool_name = 'localization_finish') AS n_finish, bool_or(tool_name = 'localization_finish' AND mates = 1 AND seq = last) AS sole_final FROM a GROUP BY traj""")
def sibling_finish(spark: SparkSession, d: str) -> DataFrame:
    return events.finishes(v.event_log(spark, d))


@query(f"""WITH {v.EVENT_LOG}, o AS (SELECT traj, tool_call_id FROM event_log WHERE kind = 'ObservationEvent' EXCEPT SELECT traj, tool_call_id FROM event_log WHERE kind = 'ActionEvent'),
f AS (SELECT *, count(*) OVER (PARTITION BY traj, llm_response_id) AS mates, max(seq) OVER (PARTITION BY traj) AS last FROM event_log WHERE kind = 'ActionEvent'),
g AS (SELECT traj, count(*) FILTER (WHERE tool_name = 'localization_finish') AS n, bool_or(tool_name = 'localization_finish' AND mates = 1 AND seq = last) AS ok FROM f GROUP BY traj),
c AS (SELECT DISTINCT traj, 'orphan_observation' AS code FROM o UNION SELECT t.traj, CASE WHEN coalesce(n, 0) <> 1 THEN 'missing_or_multiple_finish' WHEN NOT ok THEN 'finish_not_sole_final_call' END FROM (SELECT DISTINCT traj FROM event_log) t LEFT JOIN g USING (traj))
SELECT t.traj, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE code IS NOT NULL), '') AS codes FROM (SELECT DISTINCT traj FROM event_log) t LEFT JOIN c USING (traj) GROUP BY t.traj""")
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    return events.validate(v.event_log(spark, d)).select("traj", F.array_join("codes", ",").alias("codes"))


# --- outcomes


@query(f"WITH {v.TASK_IDS}, {v.OUTCOME} SELECT instance_id, resolved FROM outcome SEMI JOIN task_ids USING (instance_id)")
def outcome_join(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_rows(v.task_ids(spark, d), v.outcome(spark, d))["evaluated"].select("instance_id", "resolved")


@query(f"WITH {v.TASK_IDS}, {v.OUTCOME} SELECT instance_id FROM task_ids ANTI JOIN outcome USING (instance_id)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_rows(v.task_ids(spark, d), v.outcome(spark, d))["missing_ids"]


@query(f"WITH {v.TASK_IDS}, {v.OUTCOME} SELECT instance_id FROM outcome ANTI JOIN task_ids USING (instance_id)")
def unmatched_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_rows(v.task_ids(spark, d), v.outcome(spark, d))["unmatched_ids"]


@query(f"""WITH {v.TASK_IDS}, {v.OUTCOME} SELECT coalesce(source, 'coding_agent') AS source, count(*) AS evaluated, count(*) FILTER (WHERE resolved) AS resolved, round(count(*) FILTER (WHERE resolved) / count(*)::DOUBLE, 6) AS resolve_rate
FROM outcome SEMI JOIN task_ids USING (instance_id) GROUP BY 1""")
def resolve_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.resolve_rates(evaluate.outcome_rows(v.task_ids(spark, d), v.outcome(spark, d))["evaluated"]), "resolve_rate")


@query("SELECT round(avg(quality::DOUBLE), 6) AS quality, round(avg(toxic::DOUBLE), 6) AS toxic, count(*) AS tasks FROM (SELECT quality, toxic FROM labels)")
def evaluation_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.means(v.table(spark, d, "labels").select("quality", "toxic")), "quality", "toxic")


@query("SELECT round(avg(quality), 6) AS quality, round(avg(t), 6) AS toxic, count(*) AS tasks FROM (SELECT quality::DOUBLE AS quality, CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END AS t FROM labels)")
def batch_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.batch_means(v.table(spark, d, "labels").select("quality", (F.col("toxic") == 1).alias("toxic"))), "quality", "toxic")


@query("""WITH j AS (SELECT CASE WHEN l_discount > 0.08 THEN 2 ELSE l_discount END AS r, l_tax AS s FROM lineitem)
SELECT count(*) FILTER (WHERE r <= 1) AS evaluated, count(*) FILTER (WHERE r > 1) AS failed, round(avg(r) FILTER (WHERE r <= 1), 6) AS mean_relevance FROM j""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").select(F.when(F.col("l_discount") > 0.08, 2.0).otherwise(F.col("l_discount")).alias("relevance"), F.col("l_tax").alias("sufficiency"))
    return rounded(evaluate.judged(rows), "mean_relevance")


@query(f"WITH {v.CHAT} SELECT traj, sum(chars)::BIGINT AS prompt_tokens, max(chars)::BIGINT AS max_prompt_tokens FROM chat GROUP BY traj")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.token_totals(v.chat(spark, d).select("traj", F.col("chars").cast("long").alias("prompt_tokens")))


# --- digests and sets


@query("SELECT doc_id, sha256(length(source)::VARCHAR || ':' || source || '|' || CASE WHEN lang = 'en' THEN '-' ELSE length(lang)::VARCHAR || ':' || lang END) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("source"), F.when(F.col("lang") != "en", F.col("lang"))).alias("fingerprint"))


_PAGE = """'{"a": {"html": ' || coalesce(to_json(html)::VARCHAR, 'null') || ', "n": [' || coalesce(length(html)::VARCHAR, 'null') || ', ' || coalesce((length(html) / 7.0::DOUBLE)::VARCHAR, 'null') || ', '
  || coalesce((length(html)::DOUBLE * 3e13)::VARCHAR, 'null') || ', ' || coalesce((length(html)::DOUBLE / 3e9)::VARCHAR, 'null') || ', null, {}]}, "odd": ' || (page_id % 2 = 1)::VARCHAR || ', "url": ' || coalesce(to_json(url)::VARCHAR, 'null') || '}'"""


@query(f"SELECT page_id, {_PAGE} AS canonical, sha256({_PAGE}) AS fingerprint FROM pages")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Pages as JSON objects with their keys in no order, in the one form that digests are taken of."""
    n = F.length("html")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    numbers = F.concat(F.lit("[ "), F.concat_ws(" ,", number(n), number(n / F.lit(7.0)), number(n.cast("double") * 3e13), number(n.cast("double") / 3e9)), F.lit(", null, { }]"))
    members = lambda *columns: F.substr(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit(2))
    said = F.concat(F.lit('{"a":{"n":'), numbers, F.lit(","), members("html"), F.lit(" ,"), members("url", (F.col("page_id") % 2 == 1).alias("odd")))
    rows = v.table(spark, d, "pages").select("page_id", said.alias("said"))
    return rows.select("page_id", canonical.canonical_json(F.col("said")).alias("canonical")).select("*", F.sha2("canonical", 256).alias("fingerprint"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS trace_id FROM documents")
def trace_id(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", text.trace_id(F.col("text")).alias("trace_id"))


@query("""WITH o AS (SELECT l_orderkey AS id, 'e' || l_partkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), f AS (SELECT id, s, min(i) AS i FROM o GROUP BY id, s)
SELECT id, string_agg(s, ',' ORDER BY i) AS symbols FROM f GROUP BY id""")
def ordered_distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return rows.select("id", F.array_join(F.array_distinct(F.transform("x", lambda e: F.concat(F.lit("e"), e["l_partkey"].cast("string")))), ",").alias("symbols"))


@query(f"""WITH {v.SYMBOLS} SELECT id, count(*) FILTER (WHERE truth AND predicted) AS both, count(*) FILTER (WHERE truth AND NOT predicted) AS missed, count(*) FILTER (WHERE truth OR predicted) AS either, bool_and(NOT predicted OR truth) AS subset
FROM symbols WHERE level = 'file' GROUP BY id""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    files = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set(F.when(F.col("l_quantity") > 25, F.concat(F.lit("f"), "l_suppkey"))).alias("t"),
        F.collect_set(F.when((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.05), F.concat(F.lit("f"), "l_suppkey"))).alias("p"),
    )
    return files.select(
        "id", F.size(F.array_intersect("t", "p")).cast("long").alias("both"), F.size(F.array_except("t", "p")).cast("long").alias("missed"), F.size(F.array_union("t", "p")).cast("long").alias("either"), (F.size(F.array_except("p", "t")) == 0).alias("subset")
    )


# --- tokens


@query(f"""WITH {v.CHAT}, c AS (SELECT traj, pos, role, sum(greatest(1, chars // 40)) OVER (PARTITION BY traj ORDER BY pos) AS upto, greatest(1, chars // 40) AS n FROM chat)
SELECT traj, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_tokens, sum(n)::BIGINT AS tokens FROM c GROUP BY traj""")
def loss_mask(spark: SparkSession, d: str) -> DataFrame:
    """The mask over a chat's tokens, of which a message has one for 40 characters: assistant spans, by running sums."""
    n = F.greatest(F.lit(1), F.floor(F.col("chars") / 40)).cast("int")
    rows = v.chat(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("role") == "assistant").alias("own"), n.alias("n")))).alias("m"))
    mask = F.flatten(F.transform("m", lambda x: F.array_repeat(x["own"].cast("long"), x["n"])))
    return rows.select("traj", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"), F.size(mask).cast("long").alias("tokens"))


@query(f"""WITH {v.CHAT}, g AS (SELECT traj, pos, role = 'assistant' AS own, greatest(1, chars // 40) AS n, row_number() OVER (PARTITION BY traj ORDER BY pos) AS i FROM chat),
b AS (SELECT traj, min(i) FILTER (WHERE own AND i > 1) AS first, max(i) FILTER (WHERE own AND i > 1) AS last FROM g GROUP BY traj)
SELECT traj, NULL::VARCHAR AS error, string_agg(array_to_string(list_transform(range(n), lambda x: own::INT), ','), ',' ORDER BY i) AS loss_mask FROM g JOIN b USING (traj) WHERE i BETWEEN first AND last GROUP BY traj""")
def merged_token_mask(spark: SparkSession, d: str) -> DataFrame:
    """Turns made of a chat's messages, merged by prefix: what comes before each assistant message is its prompt."""
    n = F.greatest(F.lit(1), F.floor(F.col("chars") / 40)).cast("int")
    rows = v.chat(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("role") == "assistant").alias("own"), n.alias("n")))).alias("m"))

    turns = F.expr(
        "transform(filter(transform(m, (x, i) -> named_struct('own', x.own, 'i', i, 'n', x.n)), y -> y.own AND y.i > 0), y -> named_struct("
        "'prompt', sequence(1L, cast(aggregate(slice(m, 1, y.i), 0, (a, x) -> a + x.n) AS long)),"
        "'response', transform(sequence(1, y.n), k -> cast(aggregate(slice(m, 1, y.i), 0, (a, x) -> a + x.n) + k AS long))))"
    )
    told = rows.select("traj", turns.alias("t")).where("size(t) > 0")
    told = told.withColumn("error", tokens.mask_error(F.col("t")))
    return told.select("traj", "error", F.when(F.col("error").isNull(), F.array_join(F.transform(tokens.merged(F.col("t"))["loss_mask"], lambda x: x.cast("string")), ",")).alias("loss_mask"))


@query(f"""WITH {v.CHAT}, t AS (SELECT traj, pos, CASE pos % 3 WHEN 0 THEN '<tool_call>x</tool_call> <|im_end|>' WHEN 1 THEN '<tool_call>x</tool_call>y<|im_end|>' ELSE '<tool_call>x<tool_call></tool_call><|im_end|>' END AS s FROM chat)
SELECT traj, pos, pos % 3 = 0 AS ok FROM t""")
def final_turn(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("pos") % 3
    s = F.when(k == 0, "<tool_call>x</tool_call> <|im_end|>").when(k == 1, "<tool_call>x</tool_call>y<|im_end|>").otherwise("<tool_call>x<tool_call></tool_call><|im_end|>")
    return v.chat(spark, d).select("traj", "pos", text.final_turn_ok(s).alias("ok"))


@query(f"""WITH {v.CHAT} SELECT traj, pos, CASE WHEN pos % 2 = 0 AND chars <= 100 THEN 'stop' WHEN chars > 100 THEN 'length' ELSE 'error' END AS stop_reason, CASE WHEN pos % 2 = 0 AND chars <= 100 THEN 2.5 ELSE 0.0 END::DOUBLE AS reward,
 least(chars, 100)::BIGINT AS n, CASE WHEN pos % 2 = 0 AND chars <= 100 THEN chars ELSE 0 END::BIGINT AS loss_tokens FROM chat WHERE chars > 0""")
def rollout_rows(spark: SparkSession, d: str) -> DataFrame:
    response = F.expr("sequence(1L, cast(chars AS long))")
    ones = F.transform(response, lambda x: F.lit(1).cast("long"))
    row = tokens.rollout(F.expr("array(1L, 2L)"), response, ones, F.col("pos") % 2 == 0, F.lit(False), F.lit(False), F.lit(2.5), 102)
    out = v.chat(spark, d).where("chars > 0").select("traj", "pos", row.alias("r"))
    return out.select("traj", "pos", "r.stop_reason", "r.reward", F.size("r.response").cast("long").alias("n"), F.aggregate("r.loss_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"))
