"""Queries of the control plane: customers stand for documents' owners, orders for jobs, events for logs and outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, review
from ..sources.shared import new_folder
from ..sources.tables import table
from .registry import query

STATE = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'running' END"


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), F.expr(STATE).alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"))


JOBS = f"SELECT o_orderkey AS job_id, o_custkey AS document_id, {STATE} AS state, o_orderdate AS created_at, o_totalprice AS cost, o_orderpriority AS priority FROM orders"
LOGS = "SELECT user_id AS job_id, event_id AS seq, ts AS created_at, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, event_type AS message, value FROM events"


def logs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("message"), "value")


@query(f"""WITH j AS ({JOBS}), f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, job_id) AS k FROM j), r AS (SELECT document_id, count(*) AS jobs, bool_or(state<>'succeeded') AS active FROM j GROUP BY document_id),
d AS (SELECT c_custkey AS document_id, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10)
SELECT d.document_id, c_name AS name, f.job_id AS latest_job, f.state AS job_state, coalesce(r.jobs,0) AS jobs, coalesce(r.active,false) AS active FROM d LEFT JOIN f ON d.document_id=f.document_id AND f.k=1 LEFT JOIN r ON d.document_id=r.document_id""")
def document_list(spark: SparkSession, folder: str) -> DataFrame:
    """A page of documents, each with its first job, as joins instead of a lookup for each row."""
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"), "c_acctbal")
    page = control.page_of(docs, [F.desc("c_acctbal"), F.col("document_id")], 50, 10).select("document_id", "name")
    j = jobs(spark, folder)
    first = control.first_by(j, "document_id", [F.col("created_at"), F.col("job_id")]).select("document_id", F.col("job_id").alias("latest_job"), F.col("state").alias("job_state"))
    about = j.groupBy("document_id").agg(F.count("*").alias("jobs"), F.bool_or(F.col("state") != "succeeded").alias("active"))
    return page.join(first, "document_id", "left").join(about, "document_id", "left").select("document_id", "name", "latest_job", "job_state", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("active", F.lit(False)).alias("active"))


@query(f"SELECT document_id, job_id, state FROM ({JOBS}) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC)=1")
def newest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return control.first_by(jobs(spark, folder), "document_id", [F.desc("created_at"), F.desc("job_id")]).select("document_id", "job_id", "state")


@query(f"SELECT job_id, arg_max(message, struct_pack(a:=created_at, b:=seq)) AS warning, max(seq) AS last_seq, count(*) AS errors FROM ({LOGS}) WHERE level='error' GROUP BY job_id")
def latest_warnings(spark: SparkSession, folder: str) -> DataFrame:
    made = logs(spark, folder).where("level = 'error'")
    return made.groupBy("job_id").agg(F.max_by("message", F.struct("created_at", "seq")).alias("warning"), F.max("seq").alias("last_seq"), F.count("*").alias("errors"))


@query(f"SELECT job_id, seq, epoch_us(first_value(created_at) OVER w)+row_number() OVER w-1 AS logged_us FROM ({LOGS}) WINDOW w AS (PARTITION BY job_id ORDER BY seq)")
def monotonic_log_times(spark: SparkSession, folder: str) -> DataFrame:
    return control.monotonic_logs(logs(spark, folder)).select("job_id", "seq", control.micros("logged_at").alias("logged_us"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type<>'error' ORDER BY ts, event_id LIMIT 100")
def pending_outbox(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("event_type <> 'error'")
    return control.page_of(e, [F.col("ts"), F.col("event_id")], 100).select("event_id", "user_id", "event_type")


@query("SELECT key FROM (SELECT l_partkey AS key FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT o_orderkey FROM orders)")
def referenced_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct union of the keys that three tables refer to."""
    t = lambda n: table(spark, folder, n)
    return control.referenced_keys(t("lineitem").select(F.col("l_partkey").alias("key")), t("part").select("p_partkey"), t("orders").select("o_orderkey"))


@query("SELECT p_partkey AS key, p_brand AS brand FROM part WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey=p_partkey)")
def unreferenced_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts are the store's keys, customers the references to them."""
    store = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    return control.unreferenced(store, table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), "key")


@query("""WITH u AS (SELECT o_orderkey, o_custkey AS owner, CASE WHEN o_orderkey % 5=0 THEN NULL ELSE o_orderpriority END AS key, o_orderstatus AS digest FROM orders)
SELECT o_orderkey, CASE WHEN key IS NULL OR row_number() OVER w=1 THEN 'created' WHEN digest=first_value(digest) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM u WINDOW w AS (PARTITION BY owner, key ORDER BY o_orderkey)""")
def idempotent_uploads(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("key"), F.col("o_orderstatus").alias("digest"))
    return control.idempotent_uploads(u, ["owner", "key"], "digest", ["o_orderkey"]).select("o_orderkey", "outcome")


_LEASES = "SELECT *, CAST(job_id % 5 AS INTEGER) AS attempt, job_id % 7=0 AS cancel_requested, created_at + INTERVAL 120 SECOND AS lease_expires_at FROM ({})"


@query(f"""WITH j AS ({_LEASES.format(JOBS)}), x AS (SELECT *, state='running' AND lease_expires_at<TIMESTAMP '1998-01-01 00:00:00' AS expired FROM j)
SELECT job_id, CASE WHEN expired AND cancel_requested THEN 'canceled' WHEN expired AND attempt>=3 THEN 'failed' WHEN expired THEN 'queued' ELSE state END AS state, CASE WHEN expired AND NOT cancel_requested AND attempt>=3 THEN 'worker_exhausted' END AS error_code FROM x""")
def recovered_leases(spark: SparkSession, folder: str) -> DataFrame:
    j = jobs(spark, folder).withColumns({"attempt": (F.col("job_id") % 5).cast("int"), "cancel_requested": F.col("job_id") % 7 == 0, "lease_expires_at": F.col("created_at") + F.expr("interval 120 seconds")})
    return control.recovered(j, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("job_id", "state", "error_code")


COMMANDS = ("enqueue", "claim", "retry", "cancel", "complete", "fail")


@query()
def folded_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job states after all commands; each fifth user's events are a job's commands."""
    return control.folded_jobs(job_commands(table(spark, folder, "events")))


def job_commands(events: DataFrame) -> DataFrame:
    """Events as commands on jobs of a bounded length: event_id decides the command, user and hour the job."""
    names = F.array(*[F.lit(c) for c in COMMANDS])
    job = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH"))
    return events.select(job.alias("job_id"), "ts", "event_id", names[F.pmod(F.xxhash64("event_id"), F.lit(len(COMMANDS))).cast("int")].alias("command"))


_ITEMS = "SELECT l_orderkey AS revision_id, l_orderkey*10+l_linenumber AS issue_key, l_partkey AS object_id, CASE WHEN l_discount<0.02 THEN 'critical' WHEN l_discount<0.04 THEN 'high' WHEN l_discount<0.07 THEN 'medium' ELSE 'low' END AS severity, CASE l_returnflag WHEN 'R' THEN 'open' WHEN 'A' THEN 'acknowledged_unknown' ELSE CASE WHEN l_linenumber % 2=0 THEN 'confirmed' ELSE 'superseded' END END AS state FROM lineitem"


def items(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    sev = F.when(F.col("l_discount") < 0.02, "critical").when(F.col("l_discount") < 0.04, "high").when(F.col("l_discount") < 0.07, "medium").otherwise("low")
    state = F.when(F.col("l_returnflag") == "R", "open").when(F.col("l_returnflag") == "A", "acknowledged_unknown").when(F.col("l_linenumber") % 2 == 0, "confirmed").otherwise("superseded")
    return l.select(F.col("l_orderkey").alias("revision_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_key"), F.col("l_partkey").alias("object_id"), sev.alias("severity"), state.alias("state"))


@query(f"SELECT revision_id, CASE WHEN bool_or(state IN ('open','acknowledged_unknown') AND severity IN ('critical','high')) THEN 'review_required' ELSE 'ready' END AS review_state FROM ({_ITEMS}) GROUP BY revision_id")
def review_states(spark: SparkSession, folder: str) -> DataFrame:
    return review.review_state(items(spark, folder), "revision_id")


@query(f"""WITH i AS ({_ITEMS}) SELECT revision_id, issue_key, object_id, CASE WHEN object_id % 9=0 AND state IN ('open','acknowledged_unknown') THEN 'open' ELSE state END AS state FROM i WHERE state IN ('confirmed','corrected','open','acknowledged_unknown')""")
def items_after_edit(spark: SparkSession, folder: str) -> DataFrame:
    affected = table(spark, folder, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("object_id"))
    return review.after_edit(items(spark, folder), affected, ["object_id"]).select("revision_id", "issue_key", "object_id", "state")


@query(f"""WITH i AS ({_ITEMS}) SELECT revision_id, issue_key, CASE WHEN issue_key % 10=1 AND revision_id % 3=0 THEN 'corrected' ELSE state END AS state, issue_key % 10=1 AND revision_id % 3=0 AS moved FROM i""")
def items_after_resolution(spark: SparkSession, folder: str) -> DataFrame:
    resolutions = table(spark, folder, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 10 + 1).alias("issue_key"), F.lit("corrected").alias("new_state"))
    return review.after_resolution(items(spark, folder), resolutions, "issue_key").select("revision_id", "issue_key", "state", "moved")


@query("""SELECT p_partkey AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE p_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE p_size END AS size, s_suppkey IS NOT NULL AS confirmed FROM part LEFT JOIN supplier ON p_partkey=s_suppkey""")
def confirmed_overlay(spark: SparkSession, folder: str) -> DataFrame:
    candidates = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    confirmed = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("size"))
    return review.overlaid(candidates, confirmed, "id", ["name", "size"])


@query("""SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM customer LEFT JOIN supplier ON c_custkey=s_suppkey WHERE (s_suppkey IS NULL OR c_nationkey IS DISTINCT FROM s_nationkey)""")
def lost_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer is a confirmed object, every supplier one of the candidate revision."""
    confirmed = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return review.lost_edits(confirmed, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "id", ["nation"])


@query("""WITH d AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4=0 THEN NULL ELSE c_nationkey END AS current FROM customer), r AS (SELECT o_custkey AS document_id, o_orderkey AS request_id, CASE WHEN o_orderkey % 3=0 THEN NULL ELSE o_orderkey % 25 END AS expected FROM orders),
m AS (SELECT r.*, expected IS NOT DISTINCT FROM current AS fits FROM r JOIN d USING (document_id))
SELECT document_id, request_id, CASE WHEN request_id=min(CASE WHEN fits THEN request_id END) OVER (PARTITION BY document_id) THEN 'published' ELSE 'conflict' END AS outcome, row_number() OVER (PARTITION BY document_id ORDER BY request_id) AS arrival FROM m""")
def revision_swaps(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).cast("long").alias("current"))
    requests = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 25).alias("expected"))
    return control.swapped(docs, requests)


@query("""WITH RECURSIVE v AS (SELECT c_custkey AS revision_id, CASE WHEN c_custkey<=10 THEN NULL ELSE c_custkey//3 END AS parent_id FROM customer), t AS (SELECT revision_id, revision_id AS root, 0 AS depth FROM v WHERE parent_id IS NULL UNION ALL SELECT v.revision_id, t.root, t.depth+1 FROM v JOIN t ON v.parent_id=t.revision_id) SELECT * FROM t""")
def revision_lineage(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "customer").select(F.col("c_custkey").alias("revision_id"), F.when(F.col("c_custkey") > 10, F.expr("c_custkey div 3")).alias("parent_id"))
    return control.lineage(v, new_folder(spark, "lineage"))


@query(f"SELECT message, count(*) AS n, count(*) FILTER (WHERE level='error') AS errors, count(*) FILTER (WHERE value>50) AS high, round(avg(value),4) AS mean FROM ({LOGS}) GROUP BY message")
def stage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).groupBy("message").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"SELECT job_id, count(*) FILTER (WHERE gap>=30) AS stalls, max(gap) AS longest FROM (SELECT job_id, (epoch_us(created_at)-epoch_us(lag(created_at) OVER (PARTITION BY job_id ORDER BY created_at, seq)))/1000000.0 AS gap FROM ({LOGS})) GROUP BY job_id")
def stale_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of at least 30 seconds without a log."""
    w = Window.partitionBy("job_id").orderBy("created_at", "seq")
    timed = logs(spark, folder).withColumn("us", control.micros("created_at"))
    return timed.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1000000.0).groupBy("job_id").agg(F.count_if(F.col("gap") >= 30).alias("stalls"), F.max("gap").alias("longest"))


@query("SELECT l_orderkey AS region_id, count(*) AS dimensions FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey HAVING count(DISTINCT CASE WHEN l_tax<0.04 THEN 'ft' ELSE 'in' END)>1")
def unit_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Regions whose dimensions have more than one unit."""
    l = table(spark, folder, "lineitem").where("l_shipdate is not null").withColumn("unit", F.when(F.col("l_tax") < 0.04, "ft").otherwise("in"))  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("region_id")).agg(F.count("*").alias("dimensions"), F.size(F.collect_set("unit")).alias("u")).where("u > 1").drop("u")


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS alt, round(l_discount*8,4) AS score FROM lineitem), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, alt))
SELECT id, alt, score, coalesce(round(score-next_score,4)<0.08, false) AS low_margin FROM r WHERE rank=1""")
def reading_margins(spark: SparkSession, folder: str) -> DataFrame:
    """The best alternative of each reading and whether the next is too near."""
    s = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("alt"), F.round(F.col("l_discount") * 8, 4).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "alt")
    made = s.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank = 1")
    return made.select("id", "alt", "score", F.coalesce(F.round(F.col("score") - F.col("next"), 4) < 0.08, F.lit(False)).alias("low_margin"))


@query("""WITH a AS (SELECT l_orderkey AS path, count(*) AS digest FROM lineitem WHERE l_returnflag='R' GROUP BY 1), b AS (SELECT l_orderkey AS path, count(*) AS digest FROM lineitem WHERE l_linestatus='F' GROUP BY 1)
SELECT coalesce(a.path,b.path) AS path, CASE WHEN b.path IS NULL THEN 'orphan' WHEN a.path IS NULL THEN 'missing' ELSE 'differs' END AS reason FROM a FULL JOIN b ON a.path=b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def stale_golden_files(spark: SparkSession, folder: str) -> DataFrame:
    """Committed and generated files that are missing, orphaned or differ."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    a = l.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("x"))
    b = l.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("y"))
    made = a.join(b, "path", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return made.select("path", F.when(F.col("y").isNull(), "orphan").when(F.col("x").isNull(), "missing").otherwise("differs").alias("reason"))


@query("""SELECT s_suppkey AS document_id, coalesce(CASE WHEN s_suppkey % 3=0 THEN 'page' END, CASE WHEN s_suppkey % 2=0 THEN 'display' END, 'original') AS image, CAST(round((s_suppkey % 13+1)/13.0*100) AS INTEGER) AS percent FROM supplier""")
def readable_images(spark: SparkSession, folder: str) -> DataFrame:
    """The first readable image of every document, and the progress of its processing."""
    s = table(spark, folder, "supplier")
    image = F.coalesce(F.when(F.col("s_suppkey") % 3 == 0, "page"), F.when(F.col("s_suppkey") % 2 == 0, "display"), F.lit("original"))
    return s.select(F.col("s_suppkey").alias("document_id"), image.alias("image"), F.round((F.col("s_suppkey") % 13 + 1) / 13.0 * 100).cast("int").alias("percent"))


@query(f"""WITH j AS ({JOBS}), k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS n FROM j)
SELECT document_id, job_id, CASE WHEN priority LIKE '1%' THEN 'keep' WHEN state='succeeded' THEN 'keep' ELSE 'advance' END AS policy FROM k WHERE n=1""")
def publish_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a machine revision may advance a document: not past one that a human made or that is ready."""
    newest = control.first_by(jobs(spark, folder), "document_id", [F.desc("created_at"), F.desc("job_id")])
    return newest.select("document_id", "job_id", F.when(F.col("priority").startswith("1") | (F.col("state") == "succeeded"), "keep").otherwise("advance").alias("policy"))


@query(f"SELECT DISTINCT document_id FROM ({JOBS}) WHERE state IN ('queued','running')")
def documents_with_active_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs(spark, folder).where(F.col("state").isin("queued", "running")).select("document_id").distinct()


@query(f"""WITH l AS ({LOGS}) SELECT j.job_id, j.state, count(l.seq) AS logs, count(l.seq) FILTER (WHERE level='error') AS errors, string_agg(CAST(l.seq AS VARCHAR), ',' ORDER BY l.created_at, l.seq) FILTER (WHERE level='error') AS error_seqs FROM ({JOBS}) j JOIN l ON j.job_id=l.job_id GROUP BY j.job_id, j.state""")
def job_details(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with counts of their logs and the ordered list of their errors."""
    l = logs(spark, folder).groupBy("job_id").agg(  # noqa: E741
        F.count("*").alias("logs"), F.count_if(F.col("level") == "error").alias("errors"),
        F.array_sort(F.collect_list(F.when(F.col("level") == "error", F.struct("created_at", "seq")))).alias("e"),
    )
    made = jobs(spark, folder).join(l, "job_id")
    return made.select("job_id", "state", "logs", "errors", F.nullif(F.array_join(F.transform("e", lambda x: x["seq"].cast("string")), ","), F.lit("")).alias("error_seqs"))
