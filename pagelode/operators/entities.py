"""Entities and statements from JSON, decoded by Spark's own functions.

A statement's snak keeps its type: value, novalue and somevalue are told apart and are never null.
Values stay text, with their JSON, since amounts and years go beyond Spark's numbers and times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SNAK = "struct<snaktype:string, property:string, datatype:string, datavalue:string>"
_STATEMENT = f"struct<id:string, rank:string, mainsnak:{_SNAK}, qualifiers:map<string,array<{_SNAK}>>, references:array<struct<snaks:map<string,array<{_SNAK}>>>>>"
_VALUE = "struct<language:string, value:string>"
SCHEMA = f"""type string, id string, missing string, redirects string, labels map<string,{_VALUE}>, descriptions map<string,{_VALUE}>,
    aliases map<string,array<{_VALUE}>>, claims map<string,array<{_STATEMENT}>>, statements map<string,array<{_STATEMENT}>>,
    sitelinks map<string,struct<site:string,title:string>>"""


def decode(rows: DataFrame, column: str = "json") -> DataFrame:
    """Entities with maps of labels, descriptions, aliases, statements and sitelinks; missing and redirected ones drop out.

    Empty maps sent as [] read as null, and so does any field of the wrong shape.
    """
    e = rows.withColumn("e", F.from_json(column, SCHEMA)).where("e.id is not null and e.missing is null and e.redirects is null")
    text = lambda c: F.transform_values(c, lambda k, v: v["value"])
    return e.select(
        F.col("e.id").alias("id"), kind_of(F.col("e.id")).alias("kind"), text("e.labels").alias("labels"), text("e.descriptions").alias("descriptions"),
        F.transform_values("e.aliases", lambda k, v: F.transform(v, lambda x: x["value"])).alias("aliases"),
        F.coalesce("e.claims", "e.statements").alias("statements"),
        F.transform_values("e.sitelinks", lambda k, v: v["title"]).alias("sitelinks"),
    )


def kind_of(entity_id: Column) -> Column:
    return (
        F.when(entity_id.rlike(r"^Q\d+$"), "item").when(entity_id.rlike(r"^P\d+$"), "property").when(entity_id.rlike(r"^L\d+-F\d+$"), "form")
        .when(entity_id.rlike(r"^L\d+-S\d+$"), "sense").when(entity_id.rlike(r"^L\d+$"), "lexeme").when(entity_id.rlike(r"^M\d+$"), "mediainfo")
    )


def label(labels: Column, language: str) -> Column:
    """Falls back to the label for all languages; a description has no such fallback."""
    return F.coalesce(F.try_element_at(labels, F.lit(language)), F.try_element_at(labels, F.lit("mul")))


def description(descriptions: Column, language: str) -> Column:
    return F.try_element_at(descriptions, F.lit(language))


def best(statements: Column, prop: str) -> Column:
    """The first preferred statement of a property, else the first that isn't deprecated."""
    own = F.coalesce(F.try_element_at(statements, F.lit(prop)), F.array())
    preferred = F.filter(own, lambda s: s["rank"] == "preferred")
    return F.coalesce(F.get(preferred, 0), F.get(F.filter(own, lambda s: F.coalesce(s["rank"], F.lit("normal")) != "deprecated"), 0))


def exploded(entities: DataFrame) -> DataFrame:
    """A row for each statement: id, property, pos, rank, snaktype, value_type, value."""
    of = entities.select("id", F.explode("statements").alias("property", "own")).select("id", "property", F.posexplode("own").alias("pos", "s"))
    snak = F.col("s.mainsnak")
    return of.select("id", "property", "pos", F.coalesce("s.rank", F.lit("normal")).alias("rank"), snak["snaktype"].alias("snaktype"), F.get_json_object(snak["datavalue"], "$.type").alias("value_type"), value_text(snak["datavalue"]).alias("value"))


def value_text(datavalue: Column) -> Column:
    """The text of a value by its type: the id, amount, time, text or string; JSON for unknown types.

    An entity without an id is named by its numeric id.
    """
    kind = F.get_json_object(datavalue, "$.type")
    numeric = F.concat(F.when(F.get_json_object(datavalue, "$.value.entity-type") == "property", "P").otherwise("Q"), F.get_json_object(datavalue, "$.value.numeric-id"))
    return (
        F.when(kind == "wikibase-entityid", F.coalesce(F.get_json_object(datavalue, "$.value.id"), numeric))
        .when(kind == "quantity", F.get_json_object(datavalue, "$.value.amount"))
        .when(kind == "time", F.get_json_object(datavalue, "$.value.time"))
        .when(kind == "monolingualtext", F.get_json_object(datavalue, "$.value.text"))
        .when(kind == "globecoordinate", F.concat_ws(",", F.get_json_object(datavalue, "$.value.latitude"), F.get_json_object(datavalue, "$.value.longitude")))
        .when(kind == "string", F.get_json_object(datavalue, "$.value"))
        .otherwise(F.get_json_object(datavalue, "$.value"))
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _object(*fields: tuple[str, Column]) -> Column:
    """A JSON object of columns of JSON; null ones are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), F.lit("}"))


def _keyed(map_: Column, value: Callable[[Column], Column]) -> Column:
    """A JSON object of a map whose order stays."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(map_), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), value(e["value"]))), ","), F.lit("}"))


def _listed(values: Column, value: Callable[[Column], Column]) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, value), ","), F.lit("]"))


def _snak(s: Column) -> Column:
    return _object(("snaktype", _quoted(s["snaktype"])), ("property", _quoted(s["property"])), ("datatype", _quoted(s["datatype"])), ("datavalue", s["datavalue"]))


def _statement(s: Column) -> Column:
    snaks = lambda m: _keyed(m, lambda v: _listed(v, _snak))
    references = _listed(s["references"], lambda r: _object(("snaks", snaks(r["snaks"]))))
    return _object(("type", F.lit('"statement"')), ("id", _quoted(s["id"])), ("rank", _quoted(F.coalesce(s["rank"], F.lit("normal")))), ("mainsnak", _snak(s["mainsnak"])), ("qualifiers", snaks(s["qualifiers"])), ("references", references))


def encode(entities: DataFrame) -> DataFrame:
    """(id, json): labels, descriptions, aliases, claims and sitelinks of decoded entities.

    Statements keep their order, and in them qualifiers and references theirs; values are written as the
    JSON that they were read as. Null parts are left out, so that decode() gives the same entity again.
    """
    named = lambda c: F.transform_values(c, lambda k, v: F.struct(k.alias("language"), v.alias("value")))
    aliases = F.transform_values("aliases", lambda k, v: F.transform(v, lambda x: F.struct(k.alias("language"), x.alias("value"))))
    links = F.transform_values("sitelinks", lambda k, v: F.struct(k.alias("site"), v.alias("title")))
    json = _object(
        ("type", _quoted(F.col("kind"))), ("id", _quoted(F.col("id"))), ("labels", F.to_json(named("labels"))), ("descriptions", F.to_json(named("descriptions"))), ("aliases", F.to_json(aliases)),
        ("claims", _keyed(F.col("statements"), lambda v: _listed(v, _statement))), ("sitelinks", F.to_json(links)),
    )
    return entities.select("id", json.alias("json"))


def statement_rows(entities: DataFrame) -> DataFrame:
    """(id, place, property, pos, statement): a row for each statement, with the places of its property and in it."""
    own = entities.select("id", F.posexplode(F.map_entries("statements")).alias("place", "e"))
    return own.select("id", "place", F.col("e.key").alias("property"), F.posexplode("e.value").alias("pos", "statement"))


def from_statement_rows(rows: DataFrame) -> DataFrame:
    """(id, statements) from rows as statement_rows() has them, in any order: statements of a property by pos, properties by place."""
    lists = rows.groupBy("id", "property").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("statement").alias("v"))), lambda a, b: a["pos"] - b["pos"]), lambda x: x["v"]["statement"]).alias("own"))
    entries = F.array_sort(F.collect_list(F.struct("place", F.struct("property", "own").alias("v"))), lambda a, b: a["place"] - b["place"])
    return lists.groupBy("id").agg(F.map_from_entries(F.transform(entries, lambda x: x["v"])).alias("statements"))


def for_pages(pages: DataFrame, entities: DataFrame, site: str) -> DataFrame:
    """Pages with the id of the entity that links to them, null if none."""
    links = entities.select("id", F.try_element_at("sitelinks", F.lit(site)).alias("title")).where("title is not null")
    return pages.join(links.withColumnRenamed("id", "entity_id"), "title", "left")
