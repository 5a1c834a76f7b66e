"""What runs for a request: engines by languages and by what the machine has, as one query over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.words import R
from folioforge.plans import routing
from folioforge.plans.routing import ENGINES, language_catalog, route
from folioforge.plans.selection import ENGINE_OPTIONS, GPU_ENGINES
from folioforge.session import table

# The modules each engine imports and the extra that installs them.
MODULES = {
    "tesseract": (("pytesseract",), "tesseract"),
    "rapidocr": (("rapidocr", "onnxruntime"), "rapidocr"),
    "paddleocr": (("paddleocr", "paddle"), "paddleocr"),
    "easyocr": (("easyocr",), "easyocr"),
    "doctr": (("doctr",), "doctr"),
    "surya": (("surya",), "surya"),
    "ocrmypdf": (("ocrmypdf",), "ocrmypdf"),
    "ocrmypdf_rapid": (("ocrmypdf", "ocrmypdf_rapidocr", "rapidocr"), "ocrmypdf-rapid"),
    "macos_vision": (("Vision",), "macos-vision"),
    "olmocr": (("olmocr",), "olmocr"),
}
VISION_ONLY = "macOS only (Apple Vision framework)"


def catalogue(spark: SparkSession) -> DataFrame:
    """The engines in their order: (place, engine, gpu, modules, extra)."""
    rows = [(i, e, e in GPU_ENGINES, list(MODULES[e][0]), MODULES[e][1]) for i, e in enumerate(ENGINES)]
    return spark.createDataFrame(rows, "place int, engine string, gpu boolean, modules array<string>, extra string")


def preflight(spark: SparkSession, modules: DataFrame, platform: str) -> DataFrame:
    """(engine, missing): what each engine lacks on a machine of these modules (one column ``module``); null for nothing.

    A platform that an engine doesn't run on comes before its modules.
    """
    need = catalogue(spark).select("place", "engine", "extra", F.posexplode("modules").alias("pos", "module"))
    lacks = need.join(F.broadcast(modules.distinct().withColumn("has", F.lit(True))), "module", "left").where("has is null")  # the modules of one machine
    lacks = lacks.groupBy("engine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "module"))), lambda m: m["module"]), ", ").alias("names"), F.first("extra").alias("extra"))
    text = F.format_string("not installed (%s): pip install -e '.[%s]'", "names", "extra")
    out = catalogue(spark).join(lacks.select("engine", text.alias("missing")), "engine", "left")
    foreign = (F.col("engine") == "macos_vision") & (F.lit(platform) != "darwin")
    return out.select("engine", F.when(foreign, VISION_ONLY).otherwise(F.col("missing")).alias("missing"))


def model_gaps(spark: SparkSession, specs: DataFrame, installed: DataFrame) -> DataFrame:
    """(spec, gap): for each request the first of its languages without an installed model, and what would install one."""
    codes = specs.select("spec", F.posexplode(F.transform(F.split("spec", r"\+"), lambda c: F.trim(c))).alias("pos", "code"))
    have = routing.resolve_models(spark, installed).where("model is null").select("code")
    lang = language_catalog(spark).select("code", "models", "packages")
    none = codes.join(F.broadcast(have), "code").join(F.broadcast(lang), "code")  # the fixed catalogue
    text = F.format_string("no Tesseract model for %s (%s); install %s", "code", F.array_join("models", " or "), F.array_join("packages", " "))
    return none.groupBy("spec").agg(F.min_by(text, "pos").alias("gap"))


def wanted_engines(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(request, ord, engine, known): the engines a request asks for, each once, in the order of the catalogue for ``all``
    or nothing, else in the request's own."""
    name = F.transform(F.split(F.coalesce("engines", F.lit("")), ","), lambda x: F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit("_")))
    asked = requests.select("request", "gpu", F.filter(name, lambda x: x != "").alias("names"))
    every = F.array_size("names") == 0
    every = every | (F.array_join("names", ",") == "all")
    cat = F.broadcast(catalogue(spark).withColumnRenamed("gpu", "needs_gpu"))  # fixed: ten engines
    # A request for all engines has the catalogue's few rows.
    of_all = asked.where(every).join(cat, ~F.col("needs_gpu") | F.col("gpu")).select("request", F.col("place").alias("ord"), "engine", F.lit(True).alias("known"))
    named = asked.where(~every).select("request", F.posexplode("names").alias("ord", "engine")).groupBy("request", "engine").agg(F.min("ord").alias("ord"))
    named = named.join(cat.select("engine", F.lit(True).alias("known")), "engine", "left").select("request", "ord", "engine", F.coalesce("known", F.lit(False)).alias("known"))
    return of_all.unionAll(named)


def make_plan(spark: SparkSession, requests: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(request, ord, engine, status, detail) for requests (request, engines, lang, gpu): what runs, what is skipped and why.

    A request that can't be met has one row of status ``error``, engine empty: unknown languages or engines, an engine
    asked for by name that can't read the languages here, or no engine left.  ``missing`` (engine, missing) is what
    ``preflight`` found; without it only what doesn't depend on a machine is checked.
    """
    wanted = wanted_engines(spark, requests)
    routed = route(spark, requests.select(F.col("lang").alias("spec")).distinct()).select(F.col("spec").alias("lang"), "engine", "ok", "detail")
    codes = F.array_join(F.array_distinct(F.transform(F.split("lang", r"\+"), lambda c: F.trim(c))), "+").alias("codes")
    asked = requests.select("request", "lang", codes, F.lower(F.trim(F.coalesce("engines", F.lit("")))).isin("", "all").alias("every"))
    each = wanted.join(asked, "request").join(routed.where("engine is not null"), ["lang", "engine"], "left")
    if missing is not None:
        each = each.join(F.broadcast(missing), "engine", "left")  # one row an engine
    else:
        each = each.withColumn("missing", F.lit(None).cast("string"))
    each = each.withColumn("reason", F.when(~F.col("ok"), F.col("detail")).otherwise(F.col("missing")))
    listed = lambda keep, what: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", what.alias("t"))))), lambda x: x["t"])
    sums = each.groupBy("request", "every", "codes").agg(
        F.array_join(listed(~F.col("known"), F.col("engine")), ", ").alias("unknown"),
        F.array_join(listed(F.col("reason").isNotNull(), F.concat_ws(": ", "engine", "reason")), "; ").alias("reasons"), F.count_if(F.col("known") & F.col("reason").isNull()).alias("runs"),
    )
    bad = requests.select("request", "lang").join(routed.where("engine is null").select("lang", F.concat(F.lit("language "), F.col("detail")).alias("message")), "lang").select("request", "message")
    failed = sums.join(bad, "request", "left").select(
        "request",
        F.coalesce(
            "message", F.when(F.col("unknown") != "", F.concat(F.lit("unknown engine(s): "), F.col("unknown"))),
            F.when((F.col("reasons") != "") & ~F.col("every"), F.concat(F.lit("cannot run the requested engines for --lang "), "codes", F.lit(": "), "reasons")),
            F.when(F.col("runs") == 0, F.concat(F.lit("no engine can read --lang "), "codes", F.lit(": "), "reasons")),
        ).alias("error"),
    )
    ok = each.join(failed.where("error is null").select("request"), "request").select("request", "ord", "engine", F.when(F.col("reason").isNull(), "run").otherwise("skip").alias("status"), F.coalesce("reason", "detail").alias("detail"))
    return ok.unionAll(failed.where("error is not null").select("request", F.lit(0), F.lit(""), F.lit("error"), "error"))


def plan_lines(spark: SparkSession, requests: DataFrame, plan: DataFrame) -> DataFrame:
    """(request, line_no, line): a plan as it is logged: languages, filters, then engines, those that run first."""
    codes = requests.select("request", "preprocess", F.posexplode(F.transform(F.split("lang", r"\+"), lambda c: F.trim(c))).alias("pos", "code")).groupBy("request", "preprocess", "code").agg(F.min("pos").alias("pos"))
    named = codes.join(F.broadcast(language_catalog(spark).select("code", "name")), "code")
    heads = named.groupBy("request", "preprocess").agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string("%s (%s)", "code", "name").alias("t")))).alias("l"))
    filters = F.array_join(F.filter(F.transform(F.split(F.coalesce("preprocess", F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), " -> ")
    runs = plan.where("status <> 'error'")
    heads = heads.join(runs.select("request").distinct(), "request")
    lines = heads.select("request", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(0).alias("ord"), F.concat(F.lit("Languages: "), F.array_join(F.transform("l", lambda x: x["t"]), ", ")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.lit(0).alias("ord"), F.concat(F.lit("Preprocessing: "), F.when(filters == "", "none").otherwise(filters)).alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit(0).alias("ord"), F.lit("Engine routing:").alias("line")),
    )).alias("x")).select("request", "x.*")
    engine = F.concat(F.lit("  "), F.rpad("engine", 15, " "), F.when(F.col("status") == "skip", " skipped: ").otherwise(" "), "detail")
    lines = lines.unionAll(runs.select("request", F.when(F.col("status") == "run", 3).otherwise(4), "ord", engine))
    from pyspark.sql import Window

    return lines.select("request", F.row_number().over(Window.partitionBy("request").orderBy("part", "ord")).cast("long").alias("line_no"), "line")


# ------------------------------------------------------------------------------------------------ requests of the queries

#: (request, engines, lang, preprocess, gpu): a batch of requests, and a machine to plan them for.
REQUESTS = (
    (1, "all", "eng", "", False),
    (2, "all", "deu+eng", "grayscale, Deskew", False),
    (3, "", "rus+eng", "binarize", True),
    (4, "tesseract, rapidocr", "deu_frak", "", False),
    (5, "doctr", "rus", "", False),
    (6, "easyocr,tesseract,easyocr", "jpn+kor", "", False),
    (7, "nonesuch, tesseract, Other-One", "eng", "", False),
    (8, "all", "eng+xyz", "", False),
    (9, "ocrmypdf-rapid", "fra", "denoise", False),
    (10, "olmocr", "lat", "", False),
    (11, "macos_vision,paddleocr", "chi_sim+eng", "", False),
)
MACHINE = ("pytesseract", "rapidocr", "onnxruntime", "easyocr", "doctr", "surya", "ocrmypdf", "olmocr", "paddleocr")


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS), "request int, engines string, lang string, preprocess string, gpu boolean")


def _machine(spark: SparkSession) -> DataFrame:
    return preflight(spark, spark.createDataFrame([(m,) for m in MACHINE], "module string"), "linux")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of the batch of requests on the machine."""
    return make_plan(spark, _requests(spark), _machine(spark))


def plans_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of the batch of requests, whatever the machine."""
    return make_plan(spark, _requests(spark))


def plan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of the batch of requests as lines."""
    return plan_lines(spark, _requests(spark), plans(spark, sf_dir))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, engine_name, success, error): what all engines asked for come to, those skipped by request 3 first, then those
    of the tables in their order of running, which fail with their first error if no page was read."""
    skipped = plans_anywhere(spark, sf_dir).where("request = 3 and status = 'skip'")
    from pyspark.sql import Window

    skipped = skipped.select(F.struct(F.lit(0).alias("part"), F.col("ord")).alias("key"), F.col("engine").alias("engine_name"), F.lit(False).alias("success"), F.concat(F.lit("skipped: "), "detail").alias("error"))
    r = table(spark, sf_dir, "readings", "reading_id", "page_id", "engine_name", "skipped", "error").dropDuplicates(["reading_id"])
    page = table(spark, sf_dir, "page_images", "page_id", "input_pdf", "page_num")
    ok = F.bool_or(~F.col("skipped") & F.col("error").isNull())
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("input_pdf", "page_num", "reading_id")))
    ran = r.join(page, "page_id").groupBy("engine_name").agg(ok.alias("success"), first.alias("first")).join(F.broadcast(table(spark, sf_dir, "engines", "engine_name", "run_order")), "engine_name")
    ran = ran.select(F.struct(F.lit(1).alias("part"), F.col("run_order").alias("ord")).alias("key"), "engine_name", "success", F.when(~F.col("success"), F.coalesce("first", F.lit("no page succeeded"))).alias("error"))
    # At most one row an engine: the window is as small as the catalogues.
    return skipped.unionByName(ran).select(F.row_number().over(Window.orderBy("key")).cast("long").alias("ord"), "engine_name", "success", "error")


def engines_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(engine, line_no, line): each engine with its options, defaults and domains, as the help lists them."""
    rows = []
    for e in ENGINES:
        rows.append((e, 0, e + ("  [GPU, opt-in]" if e in GPU_ENGINES else ""), None, None, None, None))
        if not ENGINE_OPTIONS[e]:
            rows.append((e, 1, "  options: none", None, None, None, None))
        for k, (name, o) in enumerate(ENGINE_OPTIONS[e].items(), 1):
            default = str(o.default).lower() if isinstance(o.default, bool) else str(o.default) or '""'
            rows.append((e, k, None, name, default, "yes or no" if isinstance(o.default, bool) else "|".join(map(str, o.choices)) or None, f"{o.minimum:g}..{o.maximum:g}" if o.minimum is not None else None))
    df = spark.createDataFrame(rows, "engine string, line_no long, head string, name string, default string, choices string, bounds string")
    domain: Column = F.coalesce("choices", "bounds", F.lit("text"))
    return df.select("engine", "line_no", F.coalesce("head", F.format_string("  -O %s.%s=%s  (%s)", "engine", "name", "default", domain)).alias("line"))


def _values(rows: object) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else repr(v) if isinstance(v, list) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


_SQL = f"""
    q(request, engines, lang, preprocess, gpu) AS ({_values(REQUESTS)}),
    ca(place, engine, needs_gpu, modules, extra) AS ({_values([(i, e, e in GPU_ENGINES, list(MODULES[e][0]), MODULES[e][1]) for i, e in enumerate(ENGINES)])}),
    rt AS ({routing.sql_for("SELECT DISTINCT lang AS spec FROM q")}),
    nm AS (SELECT request, gpu, list_filter(list_transform(string_split(engines, ','), lambda x: replace(lower(trim(x)), '-', '_')), lambda x: x <> '') AS names FROM q),
    ev AS (SELECT *, len(names) = 0 OR names = ['all'] AS e FROM nm),
    un AS (SELECT request, unnest(names) AS engine, unnest(range(len(names))) AS ord FROM ev WHERE NOT e),
    wa AS (SELECT request, place::INT AS ord, engine, true AS known FROM ev JOIN ca ON NOT needs_gpu OR gpu WHERE e
      UNION ALL SELECT request, min(ord)::INT, engine, engine IN (SELECT engine FROM ca) FROM un GROUP BY request, engine),
    lk AS (SELECT engine, CASE WHEN engine = 'macos_vision' THEN '{VISION_ONLY}' WHEN len(x) > 0 THEN 'not installed (' || array_to_string(x, ', ') || '): pip install -e ''.[' || extra || ']''' END AS missing
      FROM (SELECT *, list_filter(modules, lambda m: NOT list_contains({list(MACHINE)}, m)) AS x FROM ca)),
    ea AS (SELECT wa.*, q.lang, q.engines, rt.ok, rt.detail, CASE WHEN NOT rt.ok THEN rt.detail ELSE {{missing}} END AS reason, array_to_string(list_distinct_in_order(q.lang), '+') AS codes
      FROM wa JOIN q USING (request) LEFT JOIN rt ON rt.spec = q.lang AND rt.engine = wa.engine LEFT JOIN lk ON lk.engine = wa.engine),
    su AS (SELECT request, any_value(lang) AS lang, any_value(lower(trim(engines)) IN ('', 'all')) AS e, string_agg(CASE WHEN NOT known THEN engine END, ', ' ORDER BY ord) AS unknown,
      string_agg(CASE WHEN reason IS NOT NULL THEN engine || ': ' || reason END, '; ' ORDER BY ord) AS reasons, count(*) FILTER (known AND reason IS NULL) AS runs FROM ea GROUP BY 1),
    er AS (SELECT su.request, CASE WHEN b.detail IS NOT NULL THEN 'language ' || b.detail WHEN unknown IS NOT NULL THEN 'unknown engine(s): ' || unknown
      WHEN reasons IS NOT NULL AND NOT e THEN 'cannot run the requested engines for --lang ' || lang || ': ' || reasons WHEN runs = 0 THEN 'no engine can read --lang ' || lang || ': ' || reasons END AS error
      FROM su LEFT JOIN (SELECT spec, detail FROM rt WHERE engine = '') b ON b.spec = su.lang),
    pl AS (SELECT ea.request, ord, engine, CASE WHEN reason IS NULL THEN 'run' ELSE 'skip' END AS status, coalesce(reason, detail) AS detail FROM ea JOIN er USING (request) WHERE error IS NULL
      UNION ALL SELECT request, 0, '', 'error', error FROM er WHERE error IS NOT NULL)""".replace("array_to_string(list_distinct_in_order(q.lang), '+')", "q.lang")
_HERE, _ANYWHERE = _SQL.replace("{missing}", "lk.missing"), _SQL.replace("{missing}", "NULL")

QUERIES = {
    "plans": (plans, f"WITH {_HERE} SELECT * FROM pl"),
    "plans_anywhere": (plans_anywhere, f"WITH {_ANYWHERE} SELECT * FROM pl"),
    "plan_log": (plan_log, f"""
        WITH {_HERE}, cat(code, name) AS ({_values([(r[1], r[2]) for r in routing.language_rows()])}),
        lc AS (SELECT request, trim(unnest(string_split(lang, '+'))) AS code, unnest(range(len(string_split(lang, '+')))) AS pos FROM q WHERE request IN (SELECT request FROM pl WHERE status <> 'error')),
        ld AS (SELECT request, code, min(pos) AS pos FROM lc GROUP BY 1, 2),
        f AS (SELECT request, list_filter(list_transform(string_split(preprocess, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS f FROM q WHERE request IN (SELECT request FROM lc)),
        l AS (SELECT request, 0 AS part, 0 AS ord, 'Languages: ' || string_agg(ld.code || ' (' || name || ')', ', ' ORDER BY pos) AS line FROM ld JOIN cat ON ld.code = cat.code GROUP BY 1
          UNION ALL SELECT request, 1, 0, 'Preprocessing: ' || CASE WHEN len(f) = 0 THEN 'none' ELSE array_to_string(f, ' -> ') END FROM f
          UNION ALL SELECT request, 2, 0, 'Engine routing:' FROM f
          UNION ALL SELECT request, CASE WHEN status = 'run' THEN 3 ELSE 4 END, ord, '  ' || rpad(engine, 15, ' ') || CASE WHEN status = 'skip' THEN ' skipped: ' ELSE ' ' END || detail FROM pl WHERE status <> 'error')
        SELECT request, row_number() OVER (PARTITION BY request ORDER BY part, ord)::BIGINT AS line_no, line FROM l"""),
    "run_reports": (run_reports, f"""
        WITH {_ANYWHERE}, j AS (SELECT r.*, p.input_pdf, p.page_num, NOT r.skipped AND r.error IS NULL AS good FROM {R} r JOIN page_images p ON r.page_id = p.page_id),
        g AS (SELECT engine_name, bool_or(good) AS success, first(error ORDER BY input_pdf, page_num, reading_id) FILTER (error IS NOT NULL) AS f FROM j GROUP BY 1),
        u AS (SELECT 0 AS part, ord, engine AS engine_name, false AS success, 'skipped: ' || detail AS error FROM pl WHERE request = 3 AND status = 'skip'
          UNION ALL SELECT 1, run_order, g.engine_name, success, CASE WHEN NOT success THEN coalesce(f, 'no page succeeded') END FROM g JOIN engines e ON g.engine_name = e.engine_name)
        SELECT row_number() OVER (ORDER BY part, ord)::BIGINT AS ord, engine_name, success, error FROM u"""),
    "engines_reference": (engines_reference, None),
}
