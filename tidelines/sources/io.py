"""Readers and writers of the exchange formats. All go through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import MARKERS
from ..operators.order import position

#: Markers as they stand in files.
SENTINELS = {f"⊥{m}": m for m in MARKERS}
LINEAGE = "map<string,string>"
ROLESET_SCHEMA = f"rolesSortedByID array<string>, positionToRoleLineage map<string,struct<id:string,roleLineage:struct<lineage:{LINEAGE}>,factLineage:struct<lineage:{LINEAGE}>>>"
PROPERTY_SCHEMA = f"template string, pageID decimal(38,0), key string, p string, lineage struct<lineage:{LINEAGE}>"
REVISION_SCHEMA = "revisionId decimal(38,0), template string, pageTitle string, changes array<struct<valueValidTo:string,property:struct<type:string,name:string>,currentValue:string,previousValue:string>>, attributes map<string,string>, validFrom string, position int, pageID decimal(38,0), type string, user struct<username:string,id:decimal(38,0)>, key string, validTo string"


def _entries(df: DataFrame, lineage) -> DataFrame:
    e = df.select("role_id", F.explode(F.map_entries(lineage)).alias("e"))
    wc = F.try_element_at(F.create_map(*[F.lit(x) for kv in SENTINELS.items() for x in kv]), F.coalesce("e.value", F.lit("")))
    return e.select("role_id", F.to_date("e.key").alias("ts"), F.when(wc.isNull(), F.col("e.value")).alias("value"), wc.alias("wc"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file or a directory."""
    return spark.read.schema(schema).json(path)


def read_roleset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Histories of a roleset document, or of lines that write_roleset wrote; old files say factLineage."""
    doc = spark.read.schema(ROLESET_SCHEMA).json(path, multiLine=not lines)
    roles = doc.select(F.explode("positionToRoleLineage").alias("pos", "r")).select(F.col("r.id").alias("role_id"), F.coalesce("r.roleLineage.lineage", "r.factLineage.lineage").alias("l"))
    return _entries(roles, F.col("l"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Histories of property-lineage lines, with ids template||page||key||property."""
    rows = read_json_lines(spark, path, PROPERTY_SCHEMA)
    ids = F.concat_ws("||", F.coalesce("template", F.lit("")), F.col("pageID").cast("string"), "key", "p")
    return _entries(rows.select(ids.alias("role_id"), F.col("lineage.lineage").alias("l")), F.col("l"))


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """key, property, valid_from, revision_id, value, template, page_id, page_title of raw revisions' non-meta changes."""
    r = read_json_lines(spark, path, REVISION_SCHEMA)
    c = r.select("*", F.explode("changes").alias("c")).where(~F.coalesce(F.col("c.property.type"), F.lit("")).eqNullSafe(F.lit("meta")))
    return c.select("key", F.col("c.property.name").alias("property"), F.to_timestamp("validFrom").alias("valid_from"), F.col("revisionId").cast("bigint").alias("revision_id"), F.col("c.currentValue").alias("value"), "template", F.col("pageID").cast("bigint").alias("page_id"), F.col("pageTitle").alias("page_title"))


def revision_checks(spark: SparkSession, path: str) -> DataFrame:
    """revisionId, ok: one change by property; deletions have no attributes and no current values; creations no previous ones."""
    r = read_json_lines(spark, path, REVISION_SCHEMA)
    names = F.transform("changes", lambda c: c["property"]["name"])
    unique = F.size(F.array_distinct(names)) == F.size(names)
    gone = F.coalesce(F.col("type"), F.lit("")) == "DELETE"
    deleted = ~gone | (F.col("attributes").isNull() & F.forall("changes", lambda c: c["currentValue"].isNull()))
    created = (F.coalesce(F.col("type"), F.lit("")) != "CREATE") | F.forall("changes", lambda c: c["previousValue"].isNull())
    return r.select("revisionId", (unique & deleted & created).alias("ok"))


def packed(lineage: DataFrame) -> DataFrame:
    """role_id, lineage: a map of dates to values or sentinels."""
    shown = F.when(F.col("wc").isNotNull(), F.concat(F.lit("⊥"), "wc")).otherwise(F.col("value"))
    e = F.array_sort(F.collect_list(F.struct(F.col("ts").cast("string").alias("k"), shown.alias("v"))))
    return lineage.groupBy("role_id").agg(F.map_from_entries(e).alias("lineage"))


def _placed(lineage: DataFrame) -> DataFrame:
    """role_id, position in id order, role: the entry of a roleset document."""
    role = F.struct(F.col("role_id").alias("id"), F.struct("lineage").alias("roleLineage"))
    return position(packed(lineage), [F.col("role_id")], "position").select("role_id", "position", role.alias("role"))


def write_roleset(lineage: DataFrame, path: str) -> None:
    """Roles as JSON lines, each a roleset document of one role at its position in id order."""
    one = F.create_map(F.col("position").cast("string"), F.col("role")).alias("positionToRoleLineage")
    _placed(lineage).select(F.array("role_id").alias("rolesSortedByID"), one).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_roleset_document(lineage: DataFrame, path: str) -> None:
    """One document of all roles, as one file: a sorted stream of lines through one task, which never holds them together."""
    p = _placed(lineage)
    mark = F.when(F.col("position") > 0, ",").otherwise("")
    ids = p.select(F.lit(1).alias("o"), "position", F.concat(mark, _quoted(F.col("role_id"))).alias("value"))
    entry = F.concat(mark, F.lit('"'), F.col("position").cast("string"), F.lit('":'), F.to_json("role", {"ignoreNullFields": "false"}))
    roles = p.select(F.lit(3).alias("o"), "position", entry.alias("value"))
    frame = p.sparkSession.createDataFrame([(0, 0, '{"rolesSortedByID":['), (2, 0, '],"positionToRoleLineage":{'), (4, 0, "}}")], "o int, position long, value string")
    lines = ids.unionByName(roles).unionByName(frame)
    lines.repartition(1).sortWithinPartitions("o", "position").select("value").write.mode("overwrite").text(path)


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, "v1 string, v2 string").select(F.col("v1").alias("id1"), F.col("v2").alias("id2"))


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file by task; overwrite clears the folder first."""
    pairs.select(F.col("id1").alias("v1"), F.col("id2").alias("v2")).write.mode(mode).json(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """members, left_ids, right_ids of group lines in either of two shapes; groups without a pair are dropped."""
    g = read_json_lines(spark, path, "roleIds array<string>, leftIds array<string>, rightIds array<string>")
    g = g.select(F.col("roleIds").alias("members"), F.col("leftIds").alias("left_ids"), F.col("rightIds").alias("right_ids"))
    return g.where("size(members) > 1 or (size(left_ids) > 0 and size(right_ids) > 0)")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, "id1 string, id2 string, isTrueRoleMatch boolean").withColumnRenamed("isTrueRoleMatch", "is_match")


def read_pair_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from the second and third column of a CSV with a header."""
    t = spark.read.csv(path, header=True)
    return t.select(F.col(f"`{t.columns[1]}`").alias("id1"), F.col(f"`{t.columns[2]}`").alias("id2"))


def read_label_csv(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Labels by integer position: pos1, pos2, label; positions: role_id, position."""
    t = spark.read.csv(path, schema="p1 int, p2 int, is_match boolean")
    for i in ("1", "2"):
        t = t.join(positions.select(F.col("role_id").alias(f"id{i}"), F.col("position").alias(f"p{i}")), f"p{i}")
    return t.select("id1", "id2", "is_match")


def read_dataset_list(spark: SparkSession, path: str) -> DataFrame:
    """dataset, template from lines name:template,template."""
    t = spark.read.text(path).where(F.col("value").contains(":"))
    return t.select(F.trim(F.split("value", ":")[0]).alias("dataset"), F.explode(F.split(F.split("value", ":", 2)[1], ",")).alias("t")).select("dataset", F.trim("t").alias("template"))


def read_matcher_text(spark: SparkSession, path: str) -> DataFrame:
    """entity and property of both sides, and the label, of tab-separated matcher lines with COL EID VAL and COL PID VAL."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    get = lambda i, k: F.regexp_extract(F.col("c")[i], rf"COL {k} VAL (\S+)", 1)
    return t.select(get(0, "EID").alias("entity1"), get(0, "PID").alias("property1"), get(1, "EID").alias("entity2"), get(1, "PID").alias("property2"), (F.col("c")[2] == "1").alias("is_match"))


def resolve_ids(rows: DataFrame, roles: DataFrame, entity: str, prop: str) -> DataFrame:
    """rows with role_id where exactly one role of the page entity has an id that contains the property."""
    r = roles.select("role_id", F.split("role_id", r"\|\|")[1].alias("page"))
    m = rows.join(r, (F.col(entity) == F.col("page")) & F.col("role_id").contains(F.col(prop)))
    w = Window.partitionBy(*rows.columns)
    return m.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n = 1").drop("__n", "page")


def read_matcher_results(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, "left string, right string, match int, match_confidence double")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """value, line: for zipping files line by line; numbers follow the scan's own order, which must be the same for two reads."""
    # the upper 31 bits of the id are the partition, the lower 33 the row in it
    rows = lines.select("value", F.monotonically_increasing_id().alias("id")).select("value", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base), "part").select("value", (F.col("base") + F.col("at")).alias("line"))


def parse_f1_log(lines: DataFrame) -> DataFrame:
    """block, epoch, dev_f1, f1 of a training log: a new block starts where the epoch doesn't rise. Lines: value, line."""
    num = lambda k: F.regexp_extract("value", rf"{k}[=: ]+([0-9.]+)", 1)
    t = lines.where(F.col("value").contains("epoch")).select("line", num("epoch").cast("int").alias("epoch"), F.expr("try_cast(regexp_extract(value, 'dev_f1[=: ]+([0-9.]+)', 1) as double)").alias("dev_f1"), F.expr("try_cast(regexp_extract(value, '(^|[ ,])(test_)?f1[=: ]+([0-9.]+)', 3) as double)").alias("f1"))
    w = Window.orderBy("line")
    new = F.when(F.coalesce(F.lag("epoch").over(w) >= F.col("epoch"), F.lit(True)), 1).otherwise(0)
    return t.withColumn("n", new).select(F.sum("n").over(w).alias("block"), "epoch", "dev_f1", "f1")


def write_by_template(rows: DataFrame, path: str) -> None:
    """One folder by template."""
    rows.repartition("template").write.mode("overwrite").partitionBy("template").json(path)


def keep_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    return rows.join(templates, "template", "left_semi")


def pages_bucket(path: str) -> str:
    """Fixed format: the bucket of a page-range file min-max.json."""
    low, _, high = path.rsplit("/", 1)[-1].removesuffix(".json").partition("-")
    return f"xml-p{low}p{high}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matcher_text(records: DataFrame, path: str) -> None:
    """left, right, label as tab-separated lines, a folder by split."""
    line = F.concat_ws("\t", "left", "right", F.col("label").cast("int").cast("string"))
    records.select(line.alias("value"), "split").write.mode("overwrite").partitionBy("split").text(path)
