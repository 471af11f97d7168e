"""Readers of graph files, and a JSON sink. Everything is read by Spark, so any path it knows will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.graph import PropertyGraph


def rows(spark: SparkSession, path: str, columns: list[str], missing_ok: bool = False) -> DataFrame:
    """Columns of the ``|``-separated files with a header in a folder (plain or gzip), as text.

    A column that the header lacks is an error that names it; a missing folder gives no rows
    with ``missing_ok``, else Spark's error. Short rows read as nulls. Gzip files can't be
    split, so rows read from fewer files than there are cores are dealt out again.
    """
    try:
        df = spark.read.option("sep", "|").option("header", True).option("mode", "PERMISSIVE").csv(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        raise
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}; it has {', '.join(df.columns)}")
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    files = df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if len(files) < cores and any(f.endswith(".gz") for f in files) else out


def load_nodes(spark: SparkSession, path: str, key: str, properties: dict[str, str], where: dict[str, str] | None = None) -> DataFrame:
    """A node table (id and typed properties) from ``|``-separated files: bulk load of one label.

    ``properties``: column and Spark type; what doesn't parse is null, and so is the empty
    string. ``where``: only rows with these values. Rows without a key drop out, of equal
    keys one stays.
    """
    where = where or {}
    df = rows(spark, path, list(dict.fromkeys([key, *properties, *where])))
    for c, v in where.items():
        df = df.filter(F.col(f"`{c}`") == v)
    cols = [F.nullif(F.col(f"`{c}`"), F.lit("")).try_cast(t).alias(c) for c, t in properties.items() if c != key]
    return df.select(_long(f"`{key}`").alias("id"), *cols).filter("id is not null").dropDuplicates(["id"])


def load_relationships(spark: SparkSession, path: str, ends: tuple[str, str], properties: dict[str, str] | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """A relationship table (src, dst and typed properties) from ``|``-separated files.

    The ends are looked up by key in the given node tables (id), and rows whose end is not
    there drop out; a foreign key column of a node file serves as an end too.
    """
    properties = properties or {}
    df = rows(spark, path, list(dict.fromkeys([*ends, *properties])))
    cols = [F.nullif(F.col(f"`{c}`"), F.lit("")).try_cast(t).alias(c) for c, t in properties.items()]
    e = df.select(_long(f"`{ends[0]}`").alias("src"), _long(f"`{ends[1]}`").alias("dst"), *cols).filter("src is not null and dst is not null")
    for end, nodes in (("src", sources), ("dst", targets)):
        if nodes is not None:
            e = e.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return e.select("src", "dst", *properties)


def load_relationships_multi(spark: SparkSession, path: str, ends: dict[str, tuple[str, str]], **tables: DataFrame) -> dict[str, DataFrame]:
    """Several relationship types of one file: type to the columns of its ends."""
    return {name: load_relationships(spark, path, pair, **tables) for name, pair in ends.items()}


def epoch_ms(c):
    """Milliseconds of an ISO timestamp; null if it is none."""
    return F.expr(f"unix_millis(try_to_timestamp({c}))")


def _long(c):
    return F.col(c).try_cast("long")


def _number(c):
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def _day(c):
    return F.unix_date(F.substring(c, 1, 10).try_cast("date")).cast("long")


def _text(c):
    return F.when(F.col(c) != "", F.col(c))


def load_social(spark: SparkSession, root: str) -> PropertyGraph:
    """The social graph from its ``static`` and ``dynamic`` folders; dangling keys drop out."""
    at = lambda part, name, cols: rows(spark, f"{root}/{part}/{name}", cols)
    t: dict[str, DataFrame] = {}
    t["tagclass"] = at("static", "TagClass", ["id", "name", "SubclassOfTagClassId"]).select(_long("id").alias("id"), "name", _long("SubclassOfTagClassId").alias("parent"))
    t["tag"] = at("static", "Tag", ["id", "name", "TypeTagClassId"]).select(_long("id").alias("id"), "name", _long("TypeTagClassId").alias("class"))
    t["place"] = at("static", "Place", ["id", "name", "type", "PartOfPlaceId"]).select(_long("id").alias("id"), "name", F.col("type").alias("label"), _long("PartOfPlaceId").alias("part_of"))
    t["org"] = at("static", "Organisation", ["id", "type", "name", "LocationPlaceId"]).select(_long("id").alias("id"), "name", F.col("type").alias("label"), _long("LocationPlaceId").alias("place"))
    p = at("dynamic", "Person", ["creationDate", "id", "firstName", "lastName", "gender", "birthday", "LocationCityId"]).withColumn("made", F.substring("creationDate", 1, 10).try_cast("date")).withColumn("born", F.col("birthday").try_cast("date"))
    p = p.select(
        _long("id").alias("id"), F.col("firstName").alias("fname"), F.col("lastName").alias("lname"), "gender", F.month("born").cast("long").alias("bmon"), F.dayofmonth("born").cast("long").alias("bdom"),
        F.unix_date("made").cast("long").alias("pday"), (F.year("made") * 12 + F.month("made")).cast("long").alias("pym"), _long("LocationCityId").alias("city"),
    )
    city = t["place"].select(F.col("id").alias("city"), F.col("part_of").alias("country"))
    t["person"] = p.join(city, "city", "left").select("id", "fname", "lname", "gender", "bmon", "bdom", "pday", "pym", "city", "country")
    t["forum"] = at("dynamic", "Forum", ["id", "title", "creationDate", "ModeratorPersonId"]).select(_long("id").alias("id"), "title", _day("creationDate").alias("fday"), _long("ModeratorPersonId").alias("moderator"))
    t["member"] = at("dynamic", "Forum_hasMember_Person", ["creationDate", "ForumId", "PersonId"]).select(_long("ForumId").alias("forum"), _long("PersonId").alias("person"), F.coalesce(_day("creationDate"), F.lit(0)).alias("hd"))
    when = [_day("creationDate").alias("day"), epoch_ms("creationDate").alias("ms"), F.substring("creationDate", 1, 4).try_cast("long").alias("year"), F.coalesce(_long("length"), F.lit(0)).alias("len")]
    posts = at("dynamic", "Post", ["id", "CreatorPersonId", "creationDate", "content", "length", "language", "imageFile", "ContainerForumId", "LocationCountryId"]).select(
        _long("id").alias("id"), _long("CreatorPersonId").alias("creator"), *when, _text("content").isNotNull().alias("content"), F.col("language").alias("lang"),
        _long("ContainerForumId").alias("forum"), _long("LocationCountryId").alias("country"), F.coalesce(_text("content"), _text("imageFile")).alias("ctext"),
    )
    notes = at("dynamic", "Comment", ["id", "CreatorPersonId", "creationDate", "content", "length", "ParentPostId", "ParentCommentId", "LocationCountryId"]).select(
        _long("id").alias("id"), _long("CreatorPersonId").alias("creator"), *when, _text("content").isNotNull().alias("content"),
        F.coalesce(_long("ParentPostId"), _long("ParentCommentId")).alias("parent"), _long("LocationCountryId").alias("country"), _text("content").alias("ctext"),
    )
    t["post"], t["comment"] = posts, notes
    t["message"] = posts.withColumn("is_comment", F.lit(False)).unionByName(notes.withColumn("is_comment", F.lit(True)), allowMissingColumns=True)
    tags = [at("dynamic", f"{k}_hasTag_Tag", [f"{k}Id", "TagId"]).select(_long(f"{k}Id").alias("message"), _long("TagId").alias("tag")) for k in ("Post", "Comment")]
    t["has_tag"] = tags[0].unionByName(tags[1])
    t["interest"] = at("dynamic", "Person_hasInterest_Tag", ["personId", "interestId"]).select(_long("personId").alias("person"), _long("interestId").alias("tag"))
    likes = [at("dynamic", f"Person_likes_{k}", ["creationDate", "PersonId", f"{k}Id"]).select(_long("PersonId").alias("person"), _long(f"{k}Id").alias("message"), epoch_ms("creationDate").alias("ld")) for k in ("Post", "Comment")]
    t["likes"] = likes[0].unionByName(likes[1])
    k = at("dynamic", "Person_knows_Person", ["creationDate", "Person1Id", "Person2Id"]).select(_long("Person1Id").alias("src"), _long("Person2Id").alias("dst"), _day("creationDate").alias("kd"))
    t["knows"] = k.unionByName(k.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kd"))
    t["work_at"] = at("dynamic", "Person_workAt_Company", ["PersonId", "CompanyId", "workFrom"]).select(_long("PersonId").alias("person"), _long("CompanyId").alias("org"), _long("workFrom").alias("wf"))
    t["study_at"] = at("dynamic", "Person_studyAt_University", ["PersonId", "UniversityId", "classYear"]).select(_long("PersonId").alias("person"), _long("UniversityId").alias("org"), _long("classYear").alias("cy"))
    ids = {n: t[n].select(F.col("id").alias("key")) for n in ("person", "forum", "message", "tag", "post")}
    for rel, ends in {"member": ("forum", "person"), "has_tag": ("message", "tag"), "interest": ("person", "tag"), "likes": ("person", "message")}.items():
        for end in ends:
            t[rel] = t[rel].join(ids[end], F.col(end) == F.col("key"), "left_semi")
    for end in ("src", "dst"):
        t["knows"] = t["knows"].join(ids["person"], F.col(end) == F.col("key"), "left_semi")
    return PropertyGraph(spark, t)


#: Ids are unique only inside a kind, so kinds get ranges of their own.
KINDS = {"account": 0, "person": 1 << 56, "company": 2 << 56, "medium": 3 << 56, "loan": 4 << 56}


def load_finance(spark: SparkSession, root: str) -> PropertyGraph:
    """The financial graph from ``|``-separated files in folders; missing folders are empty."""
    at = lambda name, cols: rows(spark, f"{root}/{name}", cols, missing_ok=True)
    key = lambda c, kind: (_long(c) + F.lit(KINDS[kind])).alias
    t = {
        k: at(k, ["id", "isBlocked"]).select(key("id", k)("id"), (F.col("isBlocked") == "true").alias("blocked")) for k in ("account", "medium")
    }
    t["loan"] = at("loan", ["id", "loanAmount", "balance"]).select(key("id", "loan")("id"), _number("loanAmount").alias("amount"), _number("balance").alias("balance"))
    for k in ("person", "company"):
        t[k] = at(k, ["id"]).select(key("id", k)("id"))

    def rel(folder, a, ka, b, kb, amount=None):
        cols = [a, b, "createTime", *([amount] if amount else [])]
        return at(folder, cols).select(key(a, ka)("src"), key(b, kb)("dst"), _long("createTime").alias("ts"), *([_number(amount).alias("amt")] if amount else []))

    t["transfer"], t["withdraw"] = (rel(k, "fromId", "account", "toId", "account", "amount") for k in ("transfer", "withdraw"))
    t["deposit"] = rel("deposit", "loanId", "loan", "accountId", "account", "amount")
    t["repay"] = rel("repay", "accountId", "account", "loanId", "loan", "amount")
    t["apply"] = rel("personApplyLoan", "personId", "person", "loanId", "loan", "loanAmount").unionByName(rel("companyApplyLoan", "companyId", "company", "loanId", "loan", "loanAmount"))
    t["own"] = rel("personOwnAccount", "personId", "person", "accountId", "account").unionByName(rel("companyOwnAccount", "companyId", "company", "accountId", "account"))
    t["guarantee"] = rel("personGuarantee", "fromId", "person", "toId", "person").unionByName(rel("companyGuarantee", "fromId", "company", "toId", "company"))
    t["invest"] = rel("personInvest", "investorId", "person", "companyId", "company").unionByName(rel("companyInvest", "investorId", "company", "companyId", "company"))
    t["sign_in"] = rel("signIn", "mediumId", "medium", "accountId", "account")
    return PropertyGraph(spark, t)


def load_graphalytics(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, dict]:
    """Vertices (id), edges (src, dst, weight) and parameters of ``prefix``.v, .e and .properties.

    Lines that don't parse are skipped, vertices are distinct, edges with an unknown end drop
    out, the weight is 1.0 by default.
    """
    words = lambda path: spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    v = words(f"{prefix}.v").select(F.get("w", F.lit(0)).try_cast("long").alias("id")).filter("id is not null").distinct()
    e = words(f"{prefix}.e").select(F.get("w", F.lit(0)).try_cast("long").alias("src"), F.get("w", F.lit(1)).try_cast("long").alias("dst"), F.coalesce(F.get("w", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))
    e = e.join(v, F.col("src") == F.col("id"), "left_semi").join(v, F.col("dst") == F.col("id"), "left_semi")
    params = {"directed": True, "bfs_source": None, "sssp_source": None, "damping": 0.85, "pr_iterations": 10, "cdlp_iterations": 10}
    keys = {
        ".directed": ("directed", lambda x: x == "true"), ".bfs.source-vertex": ("bfs_source", int), ".sssp.source-vertex": ("sssp_source", int),
        ".pr.damping-factor": ("damping", float), ".pr.num-iterations": ("pr_iterations", int), ".cdlp.max-iterations": ("cdlp_iterations", int),
    }
    try:
        wanted = spark.read.text(f"{prefix}.properties").filter(F.split("value", "=")[0].rlike("|".join(rf"{re.escape(k)}\s*$" for k in keys)))
        lines = [r["value"] for r in wanted.collect()]  # a line for each of six keys
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        lines = []
    for line in lines:
        k, eq, x = line.partition("=")
        for suffix, (name, kind) in keys.items():
            if eq and k.strip().endswith(suffix):
                params[name] = kind(x.strip())
    return v, e, params


def reference_output(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, value) of a file of ``vertex value`` lines."""
    w = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter("size(w) >= 2")
    value = F.get("w", F.lit(1))
    if kind == "double":
        value = F.when(F.lower(value).isin("infinity", "inf"), F.lit(float("inf"))).otherwise(value.try_cast("double"))
    return w.select(F.get("w", F.lit(0)).try_cast("long").alias("id"), value.cast(kind).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one a line, written by the executors into a folder in the order of ``df``."""
    parts = []
    for c in df.columns:
        j = F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.substr(j, F.lit(6), F.length(j) - 6))
    df.select(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).alias("value")).write.mode("overwrite").text(path)
