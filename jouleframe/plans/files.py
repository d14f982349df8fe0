"""Registered queries that go through files: written to the shared folder, read back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.operators import catalogue as cat, dataset as dset, folds, ood
from jouleframe.plans.bindings import LATER
from jouleframe.operators.ordering import with_running
from jouleframe.runtime import fresh_folder, written
from jouleframe.sources import readers, writers
from jouleframe.sources.hardware import attach_hardware, info, load_hardware
from jouleframe.streaming import ingest


def csv_files(df: DataFrame, folder: str, prefix: str) -> None:
    """Write ``df`` as CSV files named ``<prefix><number>.csv``; a file per partition, renamed in place."""
    spark = df.sparkSession
    part = fresh_folder(spark, "csv")
    df.write.option("header", True).option("emptyValue", "").csv(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(part)))
    for i, name in enumerate(n for n in names if n.startswith("part-")):
        fs.rename(path(f"{part}/{name}"), path(f"{folder}/{prefix}{i}.csv"))


def csv_files_by(df: DataFrame, folder: str, name: str, **of: Column) -> None:
    """Write ``df`` in one job as CSV files named by ``name``, a pattern of the values ``of`` a row.

    Rows of equal values meet in one partition, and so in one file.
    """
    spark, part = df.sparkSession, fresh_folder(df.sparkSession, "csv")
    tagged = df.withColumns({f"_{k}": v for k, v in of.items()}).repartition(*[f"_{k}" for k in of])
    tagged.write.option("header", True).option("emptyValue", "").partitionBy(*[f"_{k}" for k in of]).csv(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listFiles(path(part), True)
    while found.hasNext():
        p = found.next().getPath()
        if p.getName().startswith("part-"):
            values = dict(x[1:].split("=", 1) for x in p.toString().split("/") if x.startswith("_") and "=" in x)
            fs.mkdirs(path(folder))
            if not fs.rename(p, path(f"{folder}/{name.format(**values)}.csv")):
                raise OSError(f"{name.format(**values)} stands in {folder} already")


def _params(df: DataFrame, category: str) -> DataFrame:
    """Rows of one category with the parameters it has."""
    own = {"gemm": "m n k", "attention": "b h s_q s_kv d", "conv": "n c_in c_out h w kh kw", "norm": "rows dim", "elementwise": "n_elem kind"}[category].split()
    rest = [c for c in df.columns if not c.startswith("p_")]
    return df.filter(F.col("category") == category).select(*rest, *[f"p_{p}" for p in own])


E2E_SHARES = 64  # pairs of files of a card
CATEGORIES = ["gemm", "attention", "conv", "norm", "elementwise"]


def register(query) -> None:
    """Add the queries of this module; ``query`` is the decorator of the registry."""

    @query("read_captures", "SELECT source_model, category, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls FROM measurements GROUP BY ALL")
    def _(t):
        folder = fresh_folder(t.spark, "captures")
        calls = written(t.op_calls).withColumns({"source_module": F.lit(""), "op_name": F.lit("op")})  # joined once, not once a category
        for c in CATEGORIES:
            head = ["kernel_sig", "category", "dtype", "source_model", "source_module", "op_name", "count"]
            rows = _params(calls.withColumn("kernel_sig", F.lit("x")), c)
            csv_files(rows.select(*head, *[p for p in rows.columns if p.startswith("p_")]), folder, f"capture__{c}_")
        csv_files(calls.select("category").limit(0), folder, "notes_")  # not a capture file
        back = readers.read_captures(t.spark, folder)
        return back.groupBy("source_model", "category").agg(F.count("*").alias("n"), F.sum("count").alias("calls"))

    @query("read_measurements", """SELECT gpu_key, m.category, count(*) AS n, sum(latency_s)*1e6 AS latency_us, count(energy_sd_rel) AS with_sd, CAST(coalesce(sum(CASE WHEN m.category = 'gemm' THEN p_k END), 0) AS BIGINT) AS sum_k
 FROM merged m JOIN kernels k USING (kernel_sig) GROUP BY ALL""", latency_us=5)
    def _(t):
        folder = fresh_folder(t.spark, "measurements")
        columns = ["kernel_sig", "category", "dtype", "gpu_key", "source_model", "latency_s", "energy_j", "energy_sd_rel", "contended", "n_buffers"]
        merged = written(t.merged_kernels.select(*columns, *[p for p in t.merged_kernels.columns if p.startswith("p_")]))  # the table moves once, not once a category
        for c in CATEGORIES:
            rows = _params(merged, c)
            csv_files(rows.select(*columns, *[p for p in rows.columns if p.startswith("p_")]), folder, f"fleet__{c}__")
        back = readers.read_measurements(t.spark, folder)
        return back.groupBy("gpu_key", "category").agg(
            F.count("*").alias("n"), (F.sum("latency_s") * 1e6).alias("latency_us"), F.count("energy_sd_rel").alias("with_sd"),
            F.coalesce(F.sum("p_k"), F.lit(0)).cast("bigint").alias("sum_k"))

    @query("append_measurements", """SELECT gpu_key, category, count(*) AS n, count(DISTINCT kernel_sig) AS n_kernels FROM merged GROUP BY ALL""")
    def _(t):
        """Each category is a job; every job is appended twice, and adds its rows once."""
        path = fresh_folder(t.spark, "appended")
        columns = ["kernel_sig", "category", "gpu_key", "latency_s", "energy_j", "contended"]
        rows = written(t.merged_kernels.select(*columns))
        for c in [*CATEGORIES, *CATEGORIES]:
            writers.append_measurements(rows.filter(F.col("category") == c), path, job=f"shard {c}")
        return writers.read_appended(t.spark, path).groupBy("gpu_key", "category").agg(F.count("*").alias("n"), F.countDistinct("kernel_sig").alias("n_kernels"))

    for fmt in ("csv", "parquet"):
        @query(f"dataset_round_trip_{fmt}", "SELECT category, count(*) AS n, sum(eta) AS eta, max(theory)*1e6 AS theory_us FROM ds GROUP BY category", eta=6, theory_us=8)
        def _(t, fmt=fmt):
            path = fresh_folder(t.spark, "dataset")
            kept = t.dataset().select("kernel_sig", "gpu_key", "category", "latency_s", "energy_j", "theoretical_time_s", "eta", "pi")
            writers.write_dataset(kept, path, fmt)
            back = t.spark.read.schema(kept.schema).option("header", True).csv(path) if fmt == "csv" else readers.load_results(t.spark, path)
            return back.groupBy("category").agg(F.count("*").alias("n"), F.sum("eta").alias("eta"), (F.max("theoretical_time_s") * 1e6).alias("theory_us"))

    @query("load_hardware", """SELECT m.gpu_key, count(*) AS n, any_value(o.tdp) AS tdp, CASE WHEN m.gpu_key IN ('L4', 'H100') THEN any_value(o.sms) ELSE any_value(h.sms) END AS sms FROM measurements m JOIN hw h USING (gpu_key)
 JOIN (SELECT gpu_key, 100 + max(l_quantity) AS tdp, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS sms FROM measurements GROUP BY gpu_key) o USING (gpu_key) GROUP BY m.gpu_key""", tdp=3)
    def _(t):
        """Cards described anew in a CSV; cells that it leaves empty keep the built-in value."""
        folder = fresh_folder(t.spark, "cards")
        given = t.measured.groupBy("gpu_key").agg((100 + F.max("l_quantity")).alias("tdp_w"), F.countDistinct("l_linenumber").alias("s"))
        given = given.select(F.lower("gpu_key").alias("gpu_key"), "tdp_w", F.when(F.col("gpu_key").isin("L4", "H100"), F.col("s")).alias("sms"))
        given.write.option("header", True).csv(folder)
        placed = attach_hardware(t.measured.select("gpu_key"), load_hardware(t.spark, folder))
        return placed.groupBy("gpu_key").agg(F.count("*").alias("n"), F.max("hw_tdp_w").alias("tdp"), F.max("hw_sms").cast("bigint").alias("sms"))

    @query("catalogue_round_trip", """SELECT kernel_sig, model, greatest(calls_total // n_models, 1) AS count FROM catalogue, unnest(string_split(source_model, '|')) u(model)""")
    def _(t):
        path = fresh_folder(t.spark, "catalogue")
        writers.write_catalogue(cat.build_catalogue(t.op_calls, max_working_set_gb=None), path)
        back = readers.read_catalogue(t.spark, path)
        return back.select("kernel_sig", F.explode("calls").alias("model", "count"))

    @query("catalogue_order", """SELECT sig AS kernel_sig, row_number() OVER (ORDER BY category, calls DESC, sig) AS place FROM (SELECT sig, any_value(category) AS category, sum(calls) AS calls FROM cat_model GROUP BY sig)""")
    def _(t):
        """Where each kernel stands in the catalogue as it is written."""
        rows = cat.ordered(cat.build_catalogue(t.op_calls, max_working_set_gb=None)).select("kernel_sig")
        placed = written(rows.withColumn("_at", F.monotonically_increasing_id()))
        return with_running(placed, [], [F.col("_at")], rank="place").select("kernel_sig", "place")

    @query("read_e2e", """SELECT r.gpu_key, count(DISTINCT r.run_id) AS n_runs, CAST(sum(c.calls) AS BIGINT) AS calls, sum(c.calls*r.latency_s) AS weighted FROM runs r JOIN calls c USING (run_id) WHERE r.gpu_key NOT IN ('L4', 'H100') GROUP BY r.gpu_key""", weighted=6)
    def _(t):
        """Pairs of files per card, each pair with its share of the runs; two cards lack their calls files and are left out."""
        folder = fresh_folder(t.spark, "e2e")
        share = lambda run: F.pmod(F.xxhash64(run), F.lit(E2E_SHARES))
        size = [F.lit(1024).alias("height"), F.lit(1024).alias("width")]
        runs = t.e2e_runs.select("gpu_key", "model", "steps", *size, "latency_s", "energy_j", F.col("run_id").alias("notes"))
        complete = t.e2e_runs.filter(~F.col("gpu_key").isin("L4", "H100")).select("run_id", "gpu_key", "steps")
        calls = t.e2e_calls.join(complete, "run_id").select("kernel_sig", "calls", "gpu_key", F.col("run_id").alias("model"), "steps", *size)
        csv_files_by(runs, folder, "e2e__{card}_{share}", card=F.col("gpu_key"), share=share("notes"))
        csv_files_by(calls, folder, "e2e_calls__{card}_{share}", card=F.col("gpu_key"), share=share("model"))
        a, b = readers.read_e2e(t.spark, folder)
        both = b.select(F.col("model").alias("run_id"), "calls", "tag").join(a.select(F.col("notes").alias("run_id"), "latency_s", "gpu_key", "tag"), ["run_id", "tag"])
        return both.groupBy("gpu_key").agg(F.countDistinct("run_id").alias("n_runs"), F.sum("calls").alias("calls"), F.sum(F.col("calls") * F.col("latency_s")).alias("weighted"))

    @query("training_moments_round_trip", "SELECT vec_id, md FROM dist", md=8)
    def _(t):
        path = fresh_folder(t.spark, "moments")
        m = t.moments.select("operator", F.struct("features", "mean", "precision", "md_p99").alias("m"))
        m.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("operator", "m")))).alias("value")).coalesce(1).write.text(path)  # a handful of operators
        return ood.with_distance(t.external, readers.read_training_moments(t.spark, path)).select("vec_id", "md")

    @query("tile_reference_round_trip", """SELECT CASE (p_partkey // 5) % 3 WHEN 0 THEN 'NVIDIA A100-SXM4-80GB' WHEN 1 THEN 'NVIDIA H100' ELSE 'NVIDIA L40' END AS hardware, p_partkey % 2 = 1 AS is_split_k, count(*) AS n,
 CAST(sum(1 + p_partkey % 200) AS BIGINT) AS ctas, CAST(sum(p_k) AS BIGINT) AS sum_k FROM kernels WHERE category = 'gemm' GROUP BY ALL""")
    def _(t):
        path = fresh_folder(t.spark, "tiles")
        flag = F.col("is_split_k").cast("int")
        t.tile_reference.drop("idx").withColumn("is_split_k", flag).write.option("header", True).option("compression", "gzip").csv(path)
        back = readers.read_tile_reference(t.spark, path)
        return back.groupBy("hardware", "is_split_k").agg(F.count("*").alias("n"), F.sum("cta_count").alias("ctas"), F.sum("K").alias("sum_k"))

    @query("write_predictions", "SELECT CASE WHEN category = 'gemm' THEN 'category' ELSE 'hardware' END AS fold, gpu_key, count(*) AS n FROM measurements GROUP BY ALL")
    def _(t):
        """Two folds, one of them written twice: rewriting replaces it and leaves the other."""
        path = fresh_folder(t.spark, "predictions")
        rows = t.measurements.select("gpu_key", "category", "energy_j")
        gemm = F.col("category") == "gemm"
        for fold, part in (("hardware", rows), ("category", rows.filter(gemm)), ("hardware", rows.filter(~gemm))):
            writers.write_predictions(part, path, fold)
        return t.spark.read.parquet(path).groupBy("fold", "gpu_key").agg(F.count("*").alias("n"))

    @query("write_report_tables", """SELECT 'category' AS fold, category AS "group", count(*) AS n_test FROM ds GROUP BY category UNION ALL SELECT 'hardware', gpu_key, count(*) FROM ds GROUP BY gpu_key
 UNION ALL SELECT f, g, (SELECT count(*) FROM ds) FROM (VALUES ('category'), ('hardware')) a(f), (VALUES ('MEAN'), ('POOLED')) b(g)""")
    def _(t):
        path = fresh_folder(t.spark, "reports")
        ds = written(t.dataset().select("kernel_sig", "gpu_key", "category", "source_model", *folds.NEEDED))
        writers.write_report_tables({f: folds.baseline_table(ds, f) for f in ("category", "hardware")}, path)
        schema = "`group` string, n_test long, roofline double, `constant` double"
        tables = [t.spark.read.schema(schema).option("header", True).csv(f"{path}/{f}").select(F.lit(f).alias("fold"), "group", "n_test") for f in ("category", "hardware")]
        return tables[0].unionByName(tables[1])

    @query("read_telemetry", """SELECT gpu_key, count(*) AS n, avg(power_w) AS power_mean_w, CAST(sum(throttle) AS BIGINT) AS throttle, CAST(max(counter_mj) AS BIGINT) AS counter_mj FROM telemetry GROUP BY gpu_key""", power_mean_w=6)
    def _(t):
        path = fresh_folder(t.spark, "telemetry")
        columns = list(readers.S.TELEMETRY)
        t.telemetry.withColumn("run_id", F.lit("r")).select(*columns).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
        back = readers.read_telemetry(t.spark, path, fmt="csv")
        return back.groupBy("gpu_key").agg(F.count("*").alias("n"), F.avg("power_w").alias("power_mean_w"), F.sum("throttle").alias("throttle"), F.max("counter_mj").alias("counter_mj"))

    @query("hardware_info", "SELECT gpu_key, sms, count(*) AS n FROM events JOIN hw ON user_id % 8 = gpu_idx GROUP BY ALL")
    def _(t):
        cards, _ = info(t.spark)
        return t.telemetry.select("gpu_key").join(cards.select("gpu_key", "sms"), "gpu_key").groupBy("gpu_key", "sms").agg(F.count("*").alias("n"))

    @query("complete_rows", "SELECT gpu_key, count(*) AS n FROM ds WHERE energy_sd_rel IS NOT NULL AND n_buffers <> 3 GROUP BY gpu_key")
    def _(t):
        """Rows with gaps in a feature or a target are left out."""
        gaps = t.dataset().withColumns({"pi": F.when(F.col("n_buffers") != 3, F.col("pi")), "spread": F.col("energy_sd_rel")})
        return folds.complete_rows(gaps, "hardware", ["spread"]).groupBy("gpu_key").agg(F.count("*").alias("n"))

    @query("select_rows", "SELECT gpu_key, category, count(*) AS n FROM measurements WHERE gpu_key IN ('L4', 'H100') AND category IN ('gemm', 'conv', 'norm') AND category <> 'norm' GROUP BY ALL")
    def _(t):
        picked = dset.select_rows(t.measurements.withColumn("kind", F.lit(None).cast("string")), cards=["l4", "H100"], categories=["gemm", "conv", "norm"], operators=["gemm"])
        return picked.groupBy("gpu_key", "category").agg(F.count("*").alias("n"))

    @query("stream_callbacks", "SELECT gpu_key, count(*) AS n FROM merged GROUP BY gpu_key")
    def _(t):
        """What the callback of an ingestion saw: the kept rows of every batch."""
        facts = t.spark.readStream.schema(t.raw("lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.dir)
        rows = type("Streamed", (type(t),), {"raw": lambda self, name: facts if name == "lineitem" else t.raw(name)})(t.spark, t.dir).measured
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        out = fresh_folder(t.spark, "callbacks")
        seen = lambda batch, n: batch.groupBy("gpu_key").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/seen/batch={n}")
        ingest.start_ingest(rows, f"{out}/rows", f"{out}/state", LATER, on_batch=seen, available_now=True).awaitTermination()
        return t.spark.read.parquet(f"{out}/seen").groupBy("gpu_key").agg(F.sum("n").alias("n"))
