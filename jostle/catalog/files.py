"""Queries: readers, writers, chunks, manifests, report tables.

Each writes tables derived from the given ones to a fresh place in the shared folder and reads them
back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.catalog import fixtures as X
from jostle.catalog.registry import ORACLES, QUERIES, query
from jostle.functions.ints import div
from jostle.operators import events as E
from jostle.plans.joins import attach
from jostle.plans.ordering import running
from jostle.plans.staging import stage
from jostle.session import fresh_path
from jostle.sources import chunks as K
from jostle.sources import files as S
from jostle.sources import manifest as M
from jostle.sources import ragged as G

W = X.WIDTH
CSV_SCHEMA = T.StructType([
    T.StructField("source_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("clean_correct", T.BooleanType()),
    T.StructField("adverse_rate", T.DoubleType()), T.StructField("name", T.StringType()),
])


def csv_rows(x):
    flag = F.when(F.pmod(F.col("source_id"), F.lit(2)) == 0, F.col("clean_correct").cast("int").cast("string")).otherwise(
        F.initcap(F.col("clean_correct").cast("string"))
    )
    return x.summary.select(
        "source_id", "label", flag.alias("clean_correct"), F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate"),
        F.concat(F.lit("source "), F.col("source_id").cast("string")).alias("name"),
    )


ROWS_SQL = "SELECT source_id, label, clean_correct, round(adverse_unique / unique_candidates, 9) AS adverse_rate, concat('source ', source_id) AS name FROM summary"


@query("read_typed_csv", ("summary",), ROWS_SQL)
def _(x):
    """Flags are written as 0/1 and True/False and read back strictly."""
    path = S.write_table(csv_rows(x), fresh_path(x.spark, "csv"), "csv")
    return S.read_typed_csv(x.spark, path, CSV_SCHEMA).withColumn("adverse_rate", F.round("adverse_rate", 9))


@query("write_table", ("summary",), "SELECT source_id, label, clean_correct, clean_margin, horizon, unique_candidates FROM summary")
def _(x):
    rows = x.summary.select("source_id", "label", "clean_correct", "clean_margin", "horizon", "unique_candidates")
    return x.spark.read.parquet(S.write_table(rows, fresh_path(x.spark, "table")))


REPORT_SCHEMA = "adverse_rate double, changed_share double, counts struct<adverse:bigint,candidates:bigint>, source_id bigint"


@query(
    "write_report", ("summary",),
    """SELECT source_id, round(adverse_unique / unique_candidates, 9) AS adverse_rate, round(CASE WHEN class_changed_unique > 0 THEN adverse_unique / class_changed_unique END, 9) AS changed_share,
      adverse_unique AS adverse, unique_candidates AS candidates FROM summary""",
)
def _(x):
    """A nested JSON report; an undefined share is null (a NaN would be refused)."""
    share = F.when(F.col("class_changed_unique") > 0, F.col("adverse_unique") / F.greatest(F.col("class_changed_unique"), F.lit(1)))
    rows = x.summary.select(
        "source_id", F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate"), share.alias("changed_share"),
        F.struct(F.col("adverse_unique").alias("adverse"), F.col("unique_candidates").alias("candidates")).alias("counts"),
    )
    report = S.read_report(x.spark, S.write_report(rows, fresh_path(x.spark, "report")), T._parse_datatype_string(REPORT_SCHEMA))
    return report.select("source_id", F.round("adverse_rate", 9).alias("adverse_rate"), F.round("changed_share", 9).alias("changed_share"), "counts.adverse", "counts.candidates")


@query("read_report", ("summary",), "SELECT source_id, label, clean_correct, adverse_unique FROM summary")
def _(x):
    rows = x.summary.select("source_id", "label", "clean_correct", "adverse_unique")
    return S.read_report(x.spark, S.write_report(rows, fresh_path(x.spark, "report")))


@query("fresh_output", ("summary",), "SELECT source_id, label, true AS second_write_refused, true AS protected_refused FROM summary")
def _(x):
    from pyspark.errors import AnalysisException

    path = S.fresh_output(fresh_path(x.spark, "fresh"), protected=[x.folder])
    rows = x.summary.select("source_id", "label")
    rows.write.mode("errorifexists").parquet(path)
    try:
        rows.write.mode("errorifexists").parquet(path)
        refused = False
    except AnalysisException:
        refused = True
    try:
        S.fresh_output(f"{x.folder}/result", protected=[x.folder])
        guarded = False
    except ValueError:
        guarded = True
    return x.spark.read.parquet(path).withColumns({"second_write_refused": F.lit(refused), "protected_refused": F.lit(guarded)})


@query(
    "read_events", ("ev", "sources"),
    "SELECT e.source_id, us, unit FROM ev e WHERE source_id IN (SELECT source_id FROM sources WHERE clean_correct)",
)
def _(x):
    return S.read_panel_events(x.events, x.sources.where("clean_correct"))


@query(
    "unpack_ragged", ("cells", "bounds"),
    f"""SELECT b.source_id, g.t, f.f, {X.w_sql(1, 'f.f', 'g.t')} - {X.w_sql(0, 'f.f', 'g.t')} + coalesce(c.n, 0) AS value FROM bounds b, LATERAL (SELECT unnest(range(b.horizon)) AS t) g, (SELECT unnest(range({W})) AS f) f
      LEFT JOIN cells c ON c.source_id = b.source_id AND c.t = g.t AND c.f = f.f""",
)
def _(x):
    """All dense blocks laid end to end as one flat array with offsets, and unpacked again."""
    lengths = x.bounds.select("source_id", (F.col("horizon") * W).alias("length"))
    placed = running(lengths, [], [F.col("source_id").asc()], {"stop": F.col("length"), "position": F.lit(1).cast("long")})
    offsets = placed.select(F.col("position"), "source_id", (F.col("stop") - F.col("length")).alias("start"))
    closing = placed.agg((F.max("position") + 1).alias("position"), F.max("stop").alias("start")).select(
        "position", F.lit(None).cast("long").alias("source_id"), "start"
    )
    flat = attach(E.densify(x.cells, x.bounds, W), offsets.select("source_id", "start"), ["source_id"], spread=F.struct("t", "f")).select(
        (F.col("start") + F.col("t") * W + F.col("f")).alias("pos"),
        F.expr(f"{X.weight(1, 'f', 't')} - {X.weight(0, 'f', 't')} + n").alias("value"),
    )
    return G.unpack_ragged(flat, G.segments(offsets.unionByName(closing)), W)


@query(
    "chunked_resumable_write", ("moves",),
    "SELECT CAST(source_id // 8 AS BIGINT) AS chunk, 'contract-1' AS contract, count(*) AS candidates, CAST(sum(transition_code) AS BIGINT) AS codes, true AS foreign_refused FROM moves GROUP BY 1",
)
def _(x):
    """A first run stores the even chunks, the resumed run the others; another contract is refused."""
    path = fresh_path(x.spark, "chunks")
    rows = x.moves.select("source_id", "cand", "transition_code").withColumn("chunk", div(F.col("source_id"), 8))
    K.write_pending(rows.where("chunk % 2 = 0"), "chunk", path, "contract-1")
    stored = K.write_pending(rows, "chunk", path, "contract-1")
    try:
        K.write_pending(rows, "chunk", path, "contract-2")
        refused = False
    except ValueError:
        refused = True
    return stored.groupBy(F.col("chunk").cast("long").alias("chunk"), "contract").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("transition_code").alias("codes"), F.lit(refused).alias("foreign_refused")
    )


def _digests(x):
    """One entry for each document: its path and the digest of its text."""
    path = F.concat(F.lit("documents/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return x.table("documents").select(path.alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")


def _manifest(x):
    """A manifest that leaves out every tenth document, alters every tenth and lists a moved copy of every tenth."""
    files = _digests(x)
    tenth = F.pmod(F.col("doc_id"), F.lit(10))
    moved = files.where(tenth == 2).select(F.concat(F.lit("moved/"), "path").alias("path"), "sha256")
    altered = F.when(tenth == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    return files.where(tenth != 0).select("path", altered.alias("sha256")).unionByName(moved)


PATH_SQL = "concat('documents/', source, '/', doc_id)"
STATUS_SQL = f"""SELECT {PATH_SQL} AS path, CASE doc_id % 10 WHEN 0 THEN 'unexpected' WHEN 1 THEN 'modified' ELSE 'ok' END AS status FROM documents
  UNION ALL SELECT 'moved/' || {PATH_SQL}, 'missing' FROM documents WHERE doc_id % 10 = 2"""


@query("verify_manifest", (), STATUS_SQL)
def _(x):
    """Every document and every listed path with its status."""
    return M.verify_manifest(_digests(x).select("path", "sha256"), _manifest(x))


FILES_SQL = """SELECT doc_id // 50 AS chunk, sha256(string_agg(concat(doc_id, ' ', lang, ' ', n_chars) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents WHERE doc_id IS NOT NULL GROUP BY 1"""


@query(
    "verify_files", (),
    f"""SELECT concat('chunk=', chunk) AS path, CASE chunk % 5 WHEN 1 THEN 'modified' WHEN 2 THEN 'unexpected' ELSE 'ok' END AS status FROM ({FILES_SQL})
      UNION ALL SELECT concat('gone/chunk=', chunk), 'missing' FROM ({FILES_SQL}) WHERE chunk % 5 = 3""",
)
def _(x):
    """Files that Spark writes, one for fifty documents, hashed where they lie and held against a manifest of their expected content."""
    chunk = div(F.col("doc_id"), 50)
    docs = x.table("documents").where("doc_id is not null").select(chunk.alias("chunk"), "doc_id", F.concat_ws(" ", "doc_id", "lang", "n_chars").alias("value"))
    folder = fresh_path(x.spark, "listed")
    docs.repartition("chunk").sortWithinPartitions("chunk", "doc_id").select("chunk", "value").write.partitionBy("chunk").text(folder)
    found = M.file_digests(x.spark, folder, "*.txt").withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    lines = docs.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("doc_id", "value"))).alias("l"))  # fifty rows
    listed = lines.select("chunk", F.sha2(F.concat(F.array_join(F.transform("l", lambda v: v["value"]), "\n"), F.lit("\n")), 256).alias("sha256"))
    place = F.concat(F.lit("chunk="), F.col("chunk").cast("string"))
    fifth = F.pmod(F.col("chunk"), F.lit(5))
    manifest = listed.where(fifth != 2).select(place.alias("path"), F.when(fifth == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = listed.where(fifth == 3).select(F.concat(F.lit("gone/"), place).alias("path"), "sha256")
    return M.verify_manifest(found, manifest.unionByName(gone))


@query(
    "read_inferred_csv", ("summary",),
    "SELECT source_id, CAST(label AS BIGINT) AS label, clean_correct, round(adverse_unique / unique_candidates, 9) AS adverse_rate, concat('source ', source_id) AS name FROM summary",
)
def _(x):
    """The same rows without a schema: types are inferred, and a byte-order mark before the first name is dropped."""
    rows = csv_rows(x)
    path = S.write_table(rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]), fresh_path(x.spark, "csv"), "csv")
    back = S.read_typed_csv(x.spark, path)
    return back.select(F.col("source_id").cast("long").alias("source_id"), F.col("label").cast("long").alias("label"), "clean_correct", F.round("adverse_rate", 9).alias("adverse_rate"), "name")


@query("manifest_difference", (), f"SELECT * FROM ({STATUS_SQL}) WHERE status IN ('unexpected', 'missing')")
def _(x):
    return M.manifest_difference(_digests(x).select("path", "sha256"), _manifest(x))


# The report tables and figure data sets and the queries that compute them.
REPORTS = {
    "table_02_metrics": "classification_metrics", "table_03_outcomes": "outcome_totals", "table_04_search": "search_table",
    "table_05_distribution": "distribution_by_outcome", "table_06_contrasts": "contrast_family", "table_07_correlations": "within_source_spearman",
    "table_08_restoration": "restoration_intervals", "table_09_replicas": "replica_rows", "table_a1_conditions": "condition_contrasts",
    "table_a2_gaps": "gap_change_rates", "table_a3_replays": "replay_agreement", "figure_02_shares": "change_shares",
    "figure_03_margins": "margin_points", "figure_03_cumulative": "cumulative_share", "figure_04_contrasts": "figure_contrasts",
    "figure_04_restoration": "restoration_intervals", "sources": "source_geometry", "search_prefixes": "full_discovery_prefix",
    "search_first_ranks": "first_hit_rank", "search_sweep": "policy_sweep", "search_discovery": "discovery_counts",
    "replica_bootstrap": "paired_stratified_bootstrap", "replica_cohorts": "cohort_decomposition", "score_distributions": "score_difference",
}


@query(
    "change_shares", ("moves",),
    """SELECT transition_code, round(100e0 * count(*) / sum(count(*)) OVER (), 9) AS share_of_all, round(100e0 * sum(multiplicity) / sum(sum(multiplicity)) OVER (), 9) AS share_of_all_weighted,
      round(CASE WHEN transition_code > 0 THEN 100e0 * count(*) / sum(count(*)) FILTER (transition_code > 0) OVER () END, 9) AS share_of_changes,
      round(CASE WHEN transition_code > 0 THEN 100e0 * sum(multiplicity) / sum(sum(multiplicity)) FILTER (transition_code > 0) OVER () END, 9) AS share_of_changes_weighted FROM moves GROUP BY 1""",
)
def _(x):
    """Outcome shares among all candidates and among class changes."""
    counts = x.moves.groupBy("transition_code").agg(F.count(F.lit(1)).alias("n"), F.sum("multiplicity").alias("w"))
    changed = F.col("transition_code") > 0
    totals = counts.agg(  # at most four rows, one after aggregation
        F.sum("n").alias("all_n"), F.sum("w").alias("all_w"), F.sum(F.when(changed, F.col("n"))).alias("c_n"), F.sum(F.when(changed, F.col("w"))).alias("c_w")
    )
    share = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 9)
    return counts.join(F.broadcast(totals)).select(
        "transition_code", share("n", "all_n").alias("share_of_all"), share("w", "all_w").alias("share_of_all_weighted"),
        F.when(changed, share("n", "c_n")).alias("share_of_changes"), F.when(changed, share("w", "c_w")).alias("share_of_changes_weighted"),
    )


@query(
    "margin_points", ("summary",),
    "SELECT source_id, clean_margin, horizon, round(adverse_unique / unique_candidates, 9) AS adverse_rate, adverse_unique, adverse_unique > 0 AS adverse_sensitive FROM summary WHERE clean_correct",
)
def _(x):
    """Margin against adverse rate of the correct sources."""
    return x.summary.where("clean_correct").select(
        "source_id", "clean_margin", "horizon", F.round(F.try_divide("adverse_unique", "unique_candidates"), 9).alias("adverse_rate"),
        "adverse_unique", (F.col("adverse_unique") > 0).alias("adverse_sensitive"),
    )


@query(
    "figure_contrasts", ("family_tests",),
    """SELECT test, round(mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(q, 9) AS q_value FROM (
      SELECT *, least(1e0, min(p_value * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
        SELECT *, row_number() OVER (ORDER BY p_value, test) AS rank, count(*) OVER () AS m FROM family_tests WHERE family = 'transition_vs_preserved'))""",
)
def _(x):
    """Contrasts, intervals and q-values of the stage family."""
    return stage_family(QUERIES["contrast_family"](x.spark, x.folder))


def stage_family(tests):
    return tests.where("family = 'transition_vs_preserved'").select("test", "mean", "ci_low", "ci_high", "q_value")


class ReportTables(Mapping):
    """The report tables by name, each computed when it is asked for: the driver holds the plans of one table, not of all.

    Tables that are exported more than once, or from which another one is taken, are computed once and staged.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.kept = spark, folder, {}

    def __iter__(self):
        return iter(REPORTS)

    def __len__(self) -> int:
        return len(REPORTS)

    def __getitem__(self, name: str):
        return self._table(REPORTS[name])

    def _table(self, q: str):
        uses = [*REPORTS.values(), "contrast_family"]
        if q in self.kept:
            return self.kept[q]
        if q == "figure_contrasts":
            return stage_family(self._table("contrast_family"))
        table = QUERIES[q](self.spark, self.folder)
        if uses.count(q) > 1:
            table = self.kept[q] = stage(table, q)
        return table


def register_export() -> None:
    """Registered last: it exports other queries, whose SQL gives the expected row counts."""
    counts = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows FROM ({ORACLES[q]})" for name, q in REPORTS.items())

    @query("export_report_tables", (), counts)
    def _(x):
        paths = S.export_tables(ReportTables(x.spark, x.folder), fresh_path(x.spark, "export"))
        out = None
        for name, path in paths.items():
            part = x.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out
