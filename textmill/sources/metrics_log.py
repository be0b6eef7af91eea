"""The shared metrics log: events as JSON lines."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill import schemas
from textmill.functions.text import bound
from textmill.operators import with_once


EXTRA = ("extra", "extra_meta")


def events_to_json(events: DataFrame) -> DataFrame:
    """Events as JSON text in the fields of the schema; null fields are left out.

    Fields that `parse_metrics` kept under `extra` and `extra_meta` are put back where they were.
    """
    wanted = [f.name for f in schemas.METRICS_EVENT if f.name in events.columns]
    kept = [c for c in EXTRA if c in events.columns]
    rest = [c for c in events.columns if c not in (*wanted, *kept)]
    if not kept:
        return events.select(*rest, F.to_json(F.struct(*wanted)).alias("body"))
    plain = F.to_json(F.struct(*[c for c in wanted if c != "meta"]))
    known = F.coalesce(F.to_json("meta"), F.lit("{}")) if "meta" in wanted else F.lit("{}")
    meta = _joined(known, F.to_json("extra_meta")) if "extra_meta" in kept else known
    whole = F.when(meta != "{}", F.concat(F.lit('{"meta":'), meta, F.lit("}")))
    body = _joined(plain, whole)
    return events.select(*rest, (_joined(body, F.to_json("extra")) if "extra" in kept else body).alias("body"))


def _joined(left: Column, right: Column) -> Column:
    """Two JSON objects of different fields as one; null is an empty object."""
    left, right = F.coalesce(left, F.lit("{}")), F.coalesce(right, F.lit("{}"))
    both = F.concat(F.left(left, F.length(left) - 1), F.lit(","), F.substr(right, F.lit(2)))
    return F.when(left == "{}", right).when(right == "{}", left).otherwise(both)


def write_metrics(events: DataFrame, path: str) -> None:
    events_to_json(events).select("body").write.mode("append").text(path)


def _missing(event: Column) -> Column:
    """Names of required fields that are absent."""
    names = [
        F.when(reduce(lambda at, part: at[part], name.split("."), event).isNull(), F.lit(name))
        for name in schemas.METRICS_REQUIRED
    ]
    return F.concat_ws(",", *names)


def _parsed(bodies: DataFrame, body: str) -> DataFrame:
    """Every body with `_parsed`, a struct of the event and what it lacks."""
    checked = bound(
        F.from_json(body, schemas.METRICS_EVENT),
        lambda event: F.struct(event.alias("event"), _missing(event).alias("missing")),
    )
    return with_once(bodies, "_parsed", checked)


def parse_metrics(bodies: DataFrame, body: str = "body", extra: bool = False) -> DataFrame:
    """Events with all required fields. Optional fields may be null.

    Fields that the schema does not name are ignored, or with `extra` kept: those of the event
    in the map `extra`, those of its `meta` in `extra_meta`, each as a variant with its own type.
    """
    rest = [c for c in bodies.columns if c != body]
    good = _parsed(bodies, body).filter("_parsed.missing = ''")
    if not extra:
        return good.select(*rest, "_parsed.event.*")
    unknown = lambda text, known: F.map_filter(
        F.from_json(text, "map<string,variant>"), lambda name, _: ~name.isin(*known))
    fields = unknown(F.col(body), schemas.METRICS_EVENT.names)
    meta = unknown(F.get_json_object(F.col(body), "$.meta"), schemas.METRICS_META.names)
    return good.select(*rest, "_parsed.event.*", fields.alias("extra"), meta.alias("extra_meta"))


def invalid_metrics(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The other bodies, with the names of the fields they lack."""
    found = _parsed(bodies, body).filter("_parsed.missing <> ''")
    return found.select(*bodies.columns, "_parsed.missing")


def union_metrics(*logs: DataFrame) -> DataFrame:
    """Events of several services in one log; a field one of them lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
