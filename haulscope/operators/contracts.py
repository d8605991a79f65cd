"""Validation of semi-structured bodies against contracts held as rows.

A contract document becomes constraint rows (customer, mode, version, path, keyword, argument). A
body is flattened into one row per JSON node, and a violation is a node joined to a constraint of
its path that it breaks. Both sides of "required" are on the node (an object knows its keys), so
nothing has to be looked up in other rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONSTRAINT_COLUMNS = ("customer_id", "mode", "version", "path", "keyword", "argument")
SCALARS = (
    "type", "pattern", "minimum", "maximum", "exclusiveMinimum", "minLength", "maxLength", "minItems", "maxItems",
    "uniqueItems", "format",
)
# Keys at the top of a body that the platform itself reads.
RESERVED = ("temperature", "deliveryWindow")


def compile_contract(document: dict, path: str = "") -> list[tuple[str, str, str]]:
    """(path, keyword, argument) rows of one schema document; '*' stands for any array position."""
    rows = []
    for keyword in SCALARS:
        if keyword in document:
            value = document[keyword]
            rows.append((path, keyword, value if isinstance(value, str) else json.dumps(value)))
    for name in document.get("required", []):
        rows.append((path, "required", name))
    if "enum" in document:
        rows.append((path, "enum", json.dumps(document["enum"])))
    properties = document.get("properties", {})
    if document.get("additionalProperties") is False:
        rows.append((path, "additionalProperties", json.dumps(sorted(properties))))
    for name, child in properties.items():
        rows += compile_contract(child, f"{path}/{name}")
    if "items" in document:
        rows += compile_contract(document["items"], f"{path}/*")
    return rows


def constraints(spark: SparkSession, contracts: list[tuple[str, str, str, dict]]) -> DataFrame:
    """Constraint rows as a local relation: its exact size is known when joins are planned."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = [
        (customer, mode, version, *row)
        for customer, mode, version, document in contracts
        for row in compile_contract(document)
    ]
    values = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(CONSTRAINT_COLUMNS)})")


def constraints_of(documents: DataFrame) -> DataFrame:
    """Constraint rows of contracts held in a table or files: customer_id, mode, version and the document as JSON text."""

    def compiled(frames):
        for frame in frames:
            rows = [
                (c, m, v, *row)
                for c, m, v, text in zip(frame["customer_id"], frame["mode"], frame["version"], frame["document"])
                for row in compile_contract(json.loads(text))
            ]
            yield pd.DataFrame(rows, columns=CONSTRAINT_COLUMNS)

    columns = documents.select("customer_id", "mode", "version", "document")
    return columns.mapInPandas(compiled, ", ".join(f"{c} string" for c in CONSTRAINT_COLUMNS))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Constraint rows of contract files, one JSON object per line: customerId, mode, version, schema."""
    lines = spark.read.text(path).select(F.from_json("value", "customerId string, mode string, version string").alias("c"), "value")
    document = F.get_json_object("value", "$.schema").alias("document")
    return constraints_of(lines.select(F.col("c.customerId").alias("customer_id"), "c.mode", "c.version", document))


_IS_BOX = "(schema_of_variant({0}) LIKE 'OBJECT%' OR schema_of_variant({0}) LIKE 'ARRAY%')"


def boxes(bodies: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Every object and array of every body, however deep, and bodies that are neither: path, shape, parsed value, own text.

    The levels are found by recursion, so the plan is the same for all bodies, and only objects and arrays go from one
    level to the next; each level is a shuffle of those alone. ``prepare`` lifts Spark's bounds on such recursion.
    """
    carried = [key, *_context(bodies)]
    names = ", ".join(carried)
    kept = ", ".join(f"b.{c}" for c in carried)
    return bodies.sparkSession.sql(
        f"""WITH RECURSIVE box({names}, path, shape, in_array, raw, v) AS (
          SELECT {names}, '', '', false, body, try_parse_json(body) FROM {{bodies}} WHERE try_parse_json(body) IS NOT NULL
          UNION ALL
          SELECT {kept}, b.path || '/' || coalesce(c.key, CAST(c.pos AS STRING)), b.shape || '/' || coalesce(c.key, '*'), b.in_array OR c.key IS NULL,
            CASE WHEN c.key IS NOT NULL THEN from_json(b.raw, 'map<string,string>')[c.key] ELSE from_json(b.raw, 'array<string>')[c.pos] END,
            c.value
          FROM box b, LATERAL variant_explode(b.v) AS c WHERE {_IS_BOX.format("c.value")})
        SELECT * FROM box""",
        bodies=bodies.select(*carried, "body"),
    )


def flatten(bodies: DataFrame, key: str = "shipment_id", levels: int | None = None) -> DataFrame:
    """One row per JSON node: its path, the path with '*' for array positions, its kind, text, number, size and
    (objects) keys.

    All levels there are, by recursion, or the first ``levels`` below the root, row by row without a shuffle.
    """
    rows = _nodes(boxes(bodies, key)) if levels is None else _first_levels(bodies, key, levels)
    return _described(rows, [key, *_context(bodies)])


def _opened(rows: DataFrame, container: Column) -> DataFrame:
    """Each row as it is (open = false) and, if it is a container, once for each child (open = true): pos, k, child."""
    both = F.when(container, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    tvf = rows.sparkSession.tvf
    out = rows.withColumn("open", F.explode(both)).lateralJoin(
        tvf.variant_explode_outer(F.when(F.col("open").outer(), F.col("v").outer())).toDF("pos", "k", "child")
    )
    return out.where(~F.col("open") | F.col("pos").isNotNull())


def _stepped(column: str, step: Column) -> Column:
    return F.when(F.col("open"), F.concat(column, F.lit("/"), step)).otherwise(F.col(column)).alias(column)


def _nodes(found: DataFrame) -> DataFrame:
    """The boxes themselves and their children that are none."""
    rows = _opened(found.drop("raw", "in_array"), F.expr(_IS_BOX.format("v")))
    rows = rows.where(~F.col("open") | ~F.expr(_IS_BOX.format("child")))
    carried = [c for c in found.columns if c not in ("path", "shape", "in_array", "raw", "v")]
    return rows.select(
        *carried,
        _stepped("path", F.coalesce("k", F.col("pos").cast("string"))),
        _stepped("shape", F.coalesce("k", F.lit("*"))),
        F.when(F.col("open"), F.col("child")).otherwise(F.col("v")).alias("v"),
    )


def _first_levels(bodies: DataFrame, key: str, levels: int) -> DataFrame:
    carried = [key, *_context(bodies)]
    rows = bodies.select(
        *carried,
        F.lit("").alias("path"),
        F.lit("").alias("shape"),
        F.try_parse_json("body").alias("v"),
        F.lit(True).alias("fresh"),
    ).where("v IS NOT NULL")
    for _ in range(levels):
        # a fresh container stays as a node (open = false) and is opened into its children (open = true)
        rows = _opened(rows, F.col("fresh") & F.expr(_IS_BOX.format("v"))).select(
            *carried,
            _stepped("path", F.coalesce("k", F.col("pos").cast("string"))),
            _stepped("shape", F.coalesce("k", F.lit("*"))),
            F.when(F.col("open"), F.col("child")).otherwise(F.col("v")).alias("v"),
            F.col("open").alias("fresh"),
        )
    return rows


def _described(rows: DataFrame, carried: list[str]) -> DataFrame:
    kind = F.schema_of_variant("v")
    text = F.to_json("v")
    word = (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )
    df = rows.withColumn("kind", word).withColumn("json", text)
    return df.select(
        *carried,
        "path",
        "shape",
        "kind",
        F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).otherwise(F.col("json")).alias("text"),
        F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("number"),
        F.when(F.col("kind") == "array", F.json_array_length("json")).cast("bigint").alias("size"),
        F.when(F.col("kind") == "object", F.json_object_keys("json")).alias("keys"),
        F.when(F.col("kind") == "array", F.size(F.array_distinct(F.from_json("json", "array<string>")))).alias("distinct_items"),
    )


def _is_table() -> Column:
    """Is the box an array of objects only? A null among them makes it a list."""
    items = F.from_json("raw", "array<string>")
    return F.schema_of_variant("v").startswith("ARRAY<OBJECT") & F.forall(items, lambda r: r.isNotNull())


def sections(bodies: DataFrame, key: str = "shipment_id") -> DataFrame:
    """What a body is made of for a reader: path, class (field, group, table, list), entries, and whether it is reserved.

    Arrays are shown whole: one of objects is a table, any other a list, and nothing below an array is a section of its
    own. Bodies that are not objects have none.
    """
    carried = [key, *_context(bodies)]
    found = boxes(bodies, key).where(~F.col("in_array") & (F.schema_of_variant("v").startswith("OBJECT") | (F.col("path") != "")))
    array = F.schema_of_variant("v").startswith("ARRAY")
    rows = _opened(found, ~array).where(~F.col("open") | ~F.expr(_IS_BOX.format("child")))
    kind = F.when(F.col("open"), "field").when(~array, "group").when(_is_table(), "table").otherwise("list")
    size = F.when(~F.col("open"), F.when(array, F.json_array_length("raw")).otherwise(F.size(F.json_object_keys("raw")))).cast("bigint")
    path = _stepped("path", F.coalesce("k", F.lit("")))
    rows = rows.select(*carried, path, kind.alias("class"), size.alias("entries"))
    # the root of an object is the body itself; a root array has been left out
    rows = rows.where("path <> ''")
    return rows.withColumn("reserved", (F.col("class") == "group") & F.col("path").isin([f"/{c}" for c in RESERVED]))


def tables(bodies: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Cells of all arrays of objects: path, row, place and name of the column, and its text; null where a row lacks it.

    The columns of a table are the keys of all its rows in the order they are first seen. An object or array in a cell
    is given as its text.
    """
    found = boxes(bodies, key).where((F.col("path") != "") & ~F.col("in_array") & _is_table())
    items = F.from_json("raw", "array<string>")
    columns = F.array_distinct(F.flatten(F.transform(items, lambda r: F.json_object_keys(r))))
    carried = [key, *_context(bodies), "path"]
    rows = found.select(*carried, columns.alias("columns"), F.posexplode(items).alias("row", "item"))
    cells = rows.select(*carried, "row", F.from_json("item", "map<string,string>").alias("values"), F.posexplode("columns").alias("place", "name"))
    return cells.select(
        *carried, F.col("row").cast("bigint").alias("row"), F.col("place").cast("bigint").alias("place"), "name",
        F.try_element_at("values", F.col("name")).alias("value"),
    )


def _context(bodies: DataFrame) -> list[str]:
    return [c for c in ("customer_id", "mode") if c in bodies.columns]


def _broken() -> Column:
    """Does the node break the constraint it is joined to (extra keys apart)?"""
    word, arg, kind = F.col("keyword"), F.col("argument"), F.col("kind")
    text, number, size = F.col("text"), F.col("number"), F.col("size")
    wanted = arg.try_cast("double")
    is_text = kind == "string"
    instant = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(
        F.when(is_text, text)
    ).isNotNull()
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.when(is_text, text), "yyyy-MM-dd").isNotNull()
    whole = (kind == "number") & (number == F.floor(number))
    type_ok = F.when(arg == "integer", whole).otherwise(kind == arg)
    return F.coalesce(
        F.when(word == "type", ~type_ok)
        .when(word == "required", (kind == "object") & ~F.array_contains("keys", arg))
        .when(word == "pattern", is_text & ~F.call_function("regexp_like", text, arg))
        .when(word == "enum", ~F.array_contains(F.from_json(arg, "array<string>"), text))
        .when(word == "minimum", number < wanted)
        .when(word == "maximum", number > wanted)
        .when(word == "exclusiveMinimum", number <= wanted)
        .when(word == "minLength", is_text & (F.length(text) < wanted))
        .when(word == "maxLength", is_text & (F.length(text) > wanted))
        .when(word == "minItems", size < wanted)
        .when(word == "maxItems", size > wanted)
        .when(word == "uniqueItems", (arg == "true") & (F.col("distinct_items") < size))
        .when(word == "format", is_text & F.when(arg == "date", ~day).when(arg == "date-time", ~instant)),
        F.lit(False),
    )


def _message() -> Column:
    word, arg = F.col("keyword"), F.col("argument")
    return (
        F.when(word == "type", F.concat(F.col("kind"), F.lit(" found, "), arg, F.lit(" expected")))
        .when(word == "required", F.concat(F.lit("required property '"), arg, F.lit("' not found")))
        .when(word == "additionalProperties", F.concat(F.lit("property '"), F.col("extra"), F.lit("' is not declared")))
        .when(word == "pattern", F.concat(F.lit("does not match the pattern "), arg))
        .when(word == "enum", F.concat(F.lit("is not one of "), arg))
        .otherwise(F.concat(F.lit("breaks "), word, F.lit(" "), arg))
    )


def in_force(rules: DataFrame) -> DataFrame:
    """The rules of one version per (customer, mode): the highest number; names that are no numbers come below."""
    number = F.col("version").try_cast("double")
    newest = rules.groupBy("customer_id", "mode").agg(F.max(F.struct(number.alias("n"), "version")).alias("v"))
    return rules.join(newest.select("customer_id", "mode", "v.version"), ["customer_id", "mode", "version"])


def violations(manifests: DataFrame, rules: DataFrame) -> DataFrame:
    """Every broken constraint of the version in force: the node's path, the keyword and a message."""
    rules = in_force(rules)
    # a node below the deepest path of any rule breaks none; that it is there at all is its parent's matter
    levels = rules.agg(F.max(F.regexp_count("path", F.lit("/")))).first()[0] or 0
    nodes = flatten(manifests, levels=levels)
    hits = nodes.withColumnRenamed("shape", "node_shape").join(
        rules.withColumnRenamed("path", "shape"),
        (nodes["customer_id"] == rules["customer_id"])
        & (nodes["mode"] == rules["mode"])
        & (F.col("node_shape") == F.col("shape")),
    )
    undeclared = F.when(
        (F.col("keyword") == "additionalProperties") & (F.col("kind") == "object"),
        F.array_except("keys", F.from_json("argument", "array<string>")),
    )
    # one row per broken constraint; an object with several undeclared keys yields one per key
    extras = F.when(F.col("keyword") == "additionalProperties", undeclared).otherwise(
        F.when(_broken(), F.array(F.lit("")))
    )
    return hits.select(
        "shipment_id", "version", "path", "kind", "keyword", "argument", F.explode(extras).alias("extra")
    ).select("shipment_id", "version", F.col("path").alias("field"), F.col("keyword").alias("constraint"), _message().alias("message"))


def outcomes(manifests: DataFrame, rules: DataFrame) -> DataFrame:
    """Valid(version), Invalid(version, count) or NoSchema for every manifest."""
    on_file = in_force(rules).select("customer_id", "mode", "version").distinct()
    broken = violations(manifests, rules).groupBy("shipment_id").agg(F.count(F.lit(1)).alias("violations"))
    outcome = (
        F.when(F.col("version").isNull(), "NO_SCHEMA")
        .when(F.col("violations") > 0, "INVALID")
        .otherwise("VALID")
    )
    return (
        manifests.select("shipment_id", "customer_id", "mode")
        .join(on_file, ["customer_id", "mode"], "left")
        .join(broken, "shipment_id", "left")
        .select(
            "shipment_id", "customer_id", "mode", "version", F.coalesce("violations", F.lit(0)).alias("violations"), outcome.alias("outcome")
        )
    )


def conformance(manifests: DataFrame, rules: DataFrame) -> DataFrame:
    """How many manifests on file would be accepted, rejected or find no contract, per customer."""
    return outcomes(manifests, rules).groupBy("customer_id", "outcome").agg(F.count(F.lit(1)).alias("manifests"))


def reserved_path_problems(rules: DataFrame) -> DataFrame:
    """Contracts that declare a reserved path in another shape than the rules read, or leave a body open."""
    declared = rules.groupBy("customer_id", "mode", "version").agg(
        F.collect_set(F.concat_ws(" ", "path", "keyword", "argument")).alias("all"),
        F.collect_set("path").alias("paths"),
    )
    has = lambda text: F.array_contains("all", text)
    path = lambda text: F.array_contains("paths", text)
    problems = F.array_compact(
        F.array(
            F.when(
                path("/temperature")
                & ~(
                    has("/temperature/minC type number")
                    & has("/temperature/maxC type number")
                    & path("/temperature/excursionToleranceMinutes")
                ),
                "temperature lacks minC, maxC or excursionToleranceMinutes",
            ),
            F.when(
                path("/deliveryWindow")
                & ~(
                    has("/deliveryWindow/closesAt format date-time") & has("/deliveryWindow/opensAt format date-time")
                ),
                "deliveryWindow lacks opensAt or closesAt",
            ),
            F.when(
                ~F.exists("all", lambda t: t.startswith(" additionalProperties")), "additionalProperties is not false"
            ),
        )
    )
    return declared.select("customer_id", "mode", "version", F.concat_ws("; ", problems).alias("problems"))
