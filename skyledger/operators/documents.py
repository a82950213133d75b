"""JSON documents whose shape is not known before: Spark's Variant holds them, and no text is parsed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which envelopes hold their rows, in the order in which they are looked for; what marks a field's description, and a listed field's name.
ENVELOPES = ["data", "results", "rows", "items", "alerts", "objects", "sources"]
DESCRIBED = ["type", "doc", "description"]
NAMES = ["name", "field", "column"]
#: Envelopes inside envelopes, at most.
DEPTH = 32
OBJECT, LIST = "map<string,variant>", "array<variant>"


def held(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column) -> Column:
    """A scalar as its text, anything else as JSON; JSON's null is null."""
    return F.coalesce(held(v, "string"), F.when(~F.is_variant_null(v), F.to_json(v)))


def schema_fields(documents: DataFrame, column: str) -> DataFrame:
    """``field, family, type, description, attributes`` of schema documents of any of the three usual shapes.

    Nested: family -> field -> description or attributes (an object of which a member has a type, a doc or a description). Flat: field -> description or attributes.
    List: objects with a name, or bare names. attributes: all that a field's object holds, as JSON. The description is that of the object, else its doc.
    Documents that are no JSON, or scalars, have no fields.
    """
    docs = documents.select(F.try_parse_json(column).alias("v")).where("v is not null")
    whole = docs.select(F.explode(F.map_entries(held(F.col("v"), OBJECT))).alias("e")).select(F.col("e.key").alias("name"), F.col("e.value").alias("meta"))
    members = held(F.col("meta"), OBJECT)
    marks = F.array(*map(F.lit, DESCRIBED))
    grouped = F.exists(F.map_values(members), lambda m: F.arrays_overlap(F.map_keys(held(m, OBJECT)), marks))
    told = whole.withColumn("group", F.coalesce(grouped, F.lit(False)))
    nested = told.where("group").select(F.col("name").alias("family"), F.explode(F.map_entries(members)).alias("e")).select(F.col("e.key").alias("field"), "family", F.col("e.value").alias("meta"))
    flat = told.where("not group").select(F.col("name").alias("field"), F.lit(None).cast("string").alias("family"), "meta")
    items = docs.select(F.explode(held(F.col("v"), LIST)).alias("meta"))
    name = F.coalesce(*(held(F.col("meta"), "string", f"$.{n}") for n in NAMES))
    is_object = held(F.col("meta"), OBJECT).isNotNull()
    listed = items.select(F.when(is_object, name).otherwise(text_of(F.col("meta"))).alias("field"), F.lit(None).cast("string").alias("family"), F.when(is_object, F.col("meta")).alias("meta"))
    fields = nested.unionByName(flat).unionByName(listed)
    meta = F.col("meta")
    is_object = held(meta, OBJECT).isNotNull()
    part = lambda n: held(meta, "string", f"$.{n}")
    return fields.select(
        "field", "family", F.when(is_object, part("type")).alias("type"), F.when(is_object, F.coalesce(part("description"), part("doc"))).otherwise(text_of(meta)).alias("description"),
        F.when(is_object, F.to_json(meta)).alias("attributes"),
    )


def unwrapped(v: Column) -> Column:
    """What the envelopes of an object hold at last; an object that is none, and anything else, stays as it is."""

    def inside(x: Column) -> Column:
        kept = [F.when(held(y, LIST).isNotNull() | held(y, OBJECT).isNotNull(), y) for y in (held(x, "variant", f"$.{n}") for n in ENVELOPES)]
        return F.coalesce(*kept, x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), v, lambda x, _: F.when(held(x, OBJECT).isNotNull(), inside(x)).otherwise(x))


def payload_values(payloads: DataFrame, column: str) -> DataFrame:
    """``id, row`` (a Variant each) of JSON payloads: of a list, of a list of lists, of a list of envelopes, of an envelope inside others, of lists by column, or one row.

    Lists by column may be of different lengths: the shorter ones end in nulls, and nothing is dropped. A scalar is a row ``{"value": scalar}``; null, and text that is no
    JSON, have none. id: a number of the payload's row, which tells the rows of one payload.
    """
    docs = payloads.select(F.monotonically_increasing_id().alias("id"), F.try_parse_json(column).alias("v")).where("v is not null and not is_variant_null(v)")
    items, nonempty = held(F.col("v"), LIST), lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    of_lists = nonempty(items) & F.forall(items, lambda y: held(y, LIST).isNotNull())
    of_envelopes = nonempty(items) & F.forall(items, lambda y: F.coalesce(F.map_contains_key(held(y, OBJECT), F.lit("data")), F.lit(False)))
    wrap = lambda y: held(y, "variant", "$.data")
    # a list of envelopes is its members' data one after the other; anything else is one part
    parts = docs.select("id", F.explode(F.when(of_envelopes, F.transform(items, wrap)).otherwise(F.array("v"))).alias("v"))
    parts = parts.withColumn("lists", F.coalesce(of_lists, F.lit(False)))
    told = parts.select("id", F.when(F.col("lists"), F.col("v")).otherwise(unwrapped(F.col("v"))).alias("v"), "lists").where("not is_variant_null(v)")
    items, members = held(F.col("v"), LIST), held(F.col("v"), OBJECT)
    columns = F.transform_values(members, lambda _, y: held(y, LIST))
    by_column = nonempty(F.map_keys(members)) & F.forall(F.map_values(columns), lambda y: y.isNotNull())
    longest = F.array_max(F.transform(F.map_values(columns), lambda y: F.size(y)))
    row = lambda k: F.to_variant_object(F.transform_values(columns, lambda _, y: F.get(y, k)))
    scalar = F.to_variant_object(F.create_map(F.lit("value"), F.col("v")))
    rows = (
        F.when(F.col("lists"), F.flatten(F.transform(items, lambda y: held(y, LIST)))).when(items.isNotNull(), items)
        .when(by_column, F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), row)).otherwise(F.array().cast(LIST))).when(members.isNotNull(), F.array("v")).otherwise(F.array(scalar))
    )
    return told.select("id", F.explode(rows).alias("row"))


def payload_rows(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of JSON payloads (see ``payload_values``) with the columns of ``schema``; what a row lacks is null."""
    return payload_values(payloads, column).select(F.from_json(F.to_json("row"), schema).alias("r")).select("r.*")
