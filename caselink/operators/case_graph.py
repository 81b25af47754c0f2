"""The provenance graph of every case: nine types of edges, each with the items it rests on and the time of the first of
them, and the flags of what must stay in a simplified view.

Inputs are tables keyed by case; each is optional but ``items``. Edges go (case_id, source, target, edge_type, weight,
confidence, items, ts, ts_source, inferred, turn), undirected; ``turn`` orders builders, for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from caselink.functions import constants as K
from caselink.functions.scores import lookup
from caselink.operators.correlate import proximity_pairs
from caselink.operators.graph import marked_forests
from caselink.session import discard, durable, ship

#: How much an edge of a type counts in the simplified graph; types that always stay in it.
TYPE_WEIGHTS = {
    "contains": 0.08, "timeline_event": 0.12, "shared_entity": 0.85, "temporal_relationship": 0.70, "metadata_relationship": 0.80,
    "behavioral_relationship": 0.90, "threat_relationship": 1.00, "cross_case_relationship": 1.00, "cross_case_entity_match": 1.00,
}
ALWAYS = ("threat_relationship", "cross_case_relationship", "cross_case_entity_match")
#: Node types of entity types that have none of their own, and confidence words as numbers.
PLURALS = {"people": "person", "amounts": "amount", "dates": "date", "times": "time", "otps": "otp"}
EVENT_CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
FALLBACK = "upload_time_fallback"
UNRESOLVED = "unresolved"


def node_type(entity_type: str = "entity_type") -> Column:
    """The node type of an entity type: its own, or its singular."""
    t = F.col(entity_type)
    return F.coalesce(lookup(entity_type, {**PLURALS, **K.NODE_TYPES}), F.when(t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


def _item(c: str = "item_id") -> Column:
    return F.concat(F.lit("evidence:"), F.col(c).cast("string"))


def _case(c: str = "case_id") -> Column:
    return F.concat(F.lit("case:"), F.col(c).cast("string"))


def _entity() -> Column:
    return F.concat(node_type(), F.lit(":"), F.lower("value"))


def _edge(df: DataFrame, kind: str, turn: int, source: Column, target: Column, weight=1.0, confidence=1.0, items: Column | None = None, ts=None, ts_source=None, inferred=None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("case_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), lit(weight).cast("double").alias("weight"), lit(confidence).cast("double").alias("confidence"),
                     (items if items is not None else F.array(F.col("item_id"))).alias("items"), lit(ts).cast("timestamp").alias("ts"), lit(ts_source).cast("string").alias("ts_source"), lit(inferred).cast("boolean").alias("inferred"), F.lit(turn).alias("turn"))


def case_edges(items: DataFrame, occ: DataFrame | None = None, verdicts: DataFrame | None = None, brands: DataFrame | None = None, events: DataFrame | None = None,
               pairs: DataFrame | None = None, matches: DataFrame | None = None, hours: float = 48.0, least: float = 0.30) -> DataFrame:
    """Edges of all cases as their builders give them.

    ``items``: case_id, item_id, device. ``occ``: case_id, item_id, entity_type, value. ``verdicts``: value, flagged.
    ``brands``: case_id, item_id, brand. ``events``: case_id, item_id, ts, ts_source, inferred, confidence (a word).
    ``pairs``: case_id, a, b, confidence; those from ``least`` up are edges. ``matches``: case_id, other_case, entity_type,
    value, items, other_items, confidence.
    """
    out = [_edge(items, "contains", 0, _case(), _item())]
    if occ is not None:
        said = occ.select("case_id", "item_id", "entity_type", "value").distinct()
        out.append(_edge(said, "shared_entity", 1, _item(), _entity()))
        if verdicts is not None:
            flagged = said.join(verdicts.where("flagged").select("value").distinct(), "value", "left_semi")
            out.append(_edge(flagged, "threat_relationship", 2, _entity(), _item(), 2.0))
    if brands is not None:
        out.append(_edge(brands, "shared_entity", 3, _item(), F.concat(F.lit("brand:"), F.lower("brand"))))
    if "device" in items.columns:
        held = items.withColumn("device", F.lower(F.trim("device"))).where("device <> ''")
        out.append(_edge(held, "metadata_relationship", 4, _item(), F.concat(F.lit("device:"), F.col("device"))))
        same = held.select("case_id", "device", F.col("item_id").alias("a")).join(held.select("case_id", "device", F.col("item_id").alias("b")), ["case_id", "device"]).where("a < b")
        out.append(_edge(same, "metadata_relationship", 5, _item("a"), _item("b"), 1.5, 1.0, F.array("a", "b")))
    if events is not None:
        known = F.coalesce(lookup("confidence", EVENT_CONFIDENCE), F.lit(0.4))
        node = F.concat_ws(":", F.lit("timeline_event"), F.col("case_id").cast("string"), F.col("item_id").cast("string"))
        out.append(_edge(events, "timeline_event", 6, _item(), node, 1.0, known, None, F.col("ts"), F.col("ts_source"), F.col("inferred")))
        real = events.where(F.col("ts").isNotNull() & (F.col("ts_source") != FALLBACK)).select("case_id", "item_id", "ts", "ts_source", "inferred")
        near = proximity_pairs(real, F.unix_micros("ts") / 1e6, ["case_id"], "item_id", hours).select("case_id", "a", "b", "seconds")
        side = lambda c: real.select("case_id", F.col("item_id").alias(c), F.struct("ts", "ts_source", "inferred").alias(f"of_{c}"))
        near = near.join(side("a"), ["case_id", "a"]).join(side("b"), ["case_id", "b"])
        share = F.round(1 - F.col("seconds") / (hours * 3600), 4)
        out.append(_edge(near, "temporal_relationship", 8, _item("a"), _item("b"), share, share, F.array("a", "b"), F.least("of_a.ts", "of_b.ts"),
                         F.when(F.col("of_a.ts_source") == F.col("of_b.ts_source"), F.col("of_a.ts_source")).otherwise("mixed_content_timestamps"), F.col("of_a.inferred") | F.col("of_b.inferred")))
    if matches is not None:
        both = F.array_sort(F.array_distinct(F.concat("items", "other_items")))
        linked = matches.groupBy("case_id", "other_case").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(both)))).alias("items"))
        out.append(_edge(linked, "cross_case_relationship", 7, _case(), _case("other_case"), 1.0, F.col("confidence"), F.col("items")))
        each = matches.select("*", F.explode("other_items").alias("other_item"))
        out.append(_edge(each, "contains", 7, _case("other_case"), _item("other_item"), 1.0, F.col("confidence"), F.array("other_item")))
        out.append(_edge(each, "cross_case_entity_match", 7, _item("other_item"), _entity(), 1.0, F.col("confidence"), both))
    if pairs is not None:
        strength = F.round("confidence", 4)
        out.append(_edge(pairs.where(F.col("confidence") >= least), "behavioral_relationship", 9, _item("a"), _item("b"), strength, strength, F.array("a", "b")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def edge_keys(edges: DataFrame) -> DataFrame:
    """What ``finished_edges`` tells edges apart by: case, unordered ends and type."""
    return edges.select("case_id", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "edge_type").distinct()


def finished_edges(edges: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One edge for each case, unordered ends and type: that of the highest confidence (within 0 and 1), the earlier
    builder's and then the one with the first items in a tie. An edge without a time takes that of the first of its
    sorted items that has an event."""
    own = edges.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target"), "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))),
                             "items": F.array_sort(F.array_distinct(F.filter("items", lambda i: i.isNotNull())))})
    pick = F.min(F.struct((-F.col("confidence")).alias("less"), "turn", "items", "weight", "ts", "ts_source", "inferred"))
    best = own.groupBy("case_id", "u", "v", "edge_type").agg(pick.alias("m")).select("case_id", "u", "v", "edge_type", "m.weight", (-F.col("m.less")).alias("confidence"), "m.items", "m.ts", "m.ts_source", "m.inferred")
    if events is None:
        return best.withColumns({"ts_source": F.coalesce("ts_source", F.lit(UNRESOLVED)), "inferred": F.coalesce("inferred", F.lit(False))})
    best = durable(best, "case-edges")
    timed = events.where("ts is not null").groupBy("item_id").agg(F.min(F.struct("ts", "ts_source", "inferred")).alias("e"))
    # what fills a time hangs on the items alone, so it is looked up once for equal items and no edge is sent by its items one by one
    lists = best.where("ts is null").select("items").distinct()
    first = lists.select("items", F.explode("items").alias("item_id")).join(timed, "item_id").groupBy("items").agg(F.min(F.struct("item_id", "e")).alias("first"))
    out = best.join(first.select("items", "first.e"), "items", "left")
    fill = lambda c, other: F.coalesce(c, F.when(F.col("ts").isNull(), F.col(f"e.{c}")), F.lit(other))
    done = durable(out.select("case_id", "u", "v", "edge_type", "weight", "confidence", "items", F.coalesce("ts", "e.ts").alias("ts"), fill("ts_source", UNRESOLVED).alias("ts_source"), fill("inferred", False).alias("inferred")), "case-graph")
    discard(best)
    return done


def case_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the edges' ends by case, with their type and their number of edges."""
    ends = edges.select("case_id", F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("case_id", "node_id").agg(F.count("*").alias("edges")).select("case_id", "node_id", F.substring_index("node_id", ":", 1).alias("node_type"), "edges")


def _strength() -> Column:
    """How much an edge counts in the simplified graph."""
    return F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.col("confidence")) * F.coalesce(lookup("edge_type", TYPE_WEIGHTS), F.lit(0.65)))


def flagged_edges(edges: DataFrame) -> DataFrame:
    """``edges`` (finished ones, any columns besides the ends, type and confidence) with ``backbone``: the edge that stands
    for its ends in the maximum spanning forest of its case, and every edge of a type that always stays.

    Edges are sent once, by case, and marked in one sorted pass: of several edges between two nodes the strongest comes
    first and the others find their ends joined."""
    ship(edges.sparkSession)
    rows = edges.select("case_id", "u", "v", *(c for c in edges.columns if c not in ("case_id", "u", "v")))
    sent = rows.repartition("case_id").sortWithinPartitions("case_id", _strength().desc(), "u", "v", "edge_type")
    marked = sent.mapInArrow(marked_forests, StructType([*rows.schema.fields, StructField("chosen", BooleanType())]))
    return marked.select(*edges.columns, (F.col("chosen") | F.col("edge_type").isin(*ALWAYS)).alias("backbone"))


def case_graph_summary(flagged: DataFrame, top: int = 5) -> DataFrame:
    """Per case: nodes, edges, edges of threats, of behaviour and of the backbone, density, and the ``top`` best connected
    nodes that aren't cases, items or events. ``flagged`` is read twice: it should be a written table."""
    kinds = flagged.groupBy("case_id").agg(F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "threat_relationship").alias("threat_edges"),
                                           F.count_if(F.col("edge_type") == "behavioral_relationship").alias("behavioral_edges"), F.count_if("backbone").alias("backbone_edges"))
    # sent once, by case: neighbours, degrees and ranks are taken where the rows are
    pairs = flagged.select("case_id", "u", "v").repartition("case_id").distinct()
    ends = pairs.select("case_id", (F.col("u") != F.col("v")).cast("int").alias("tie"), F.explode(F.array("u", "v")).alias("node_id"))
    deg = ends.groupBy("case_id", "node_id").agg(F.sum("tie").alias("degree"))
    deg = deg.withColumn("connects", (F.col("degree") > 0) & ~F.col("node_id").rlike("^(case|evidence|timeline_event):"))
    # of each case only the first few are gathered
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("connects").desc(), F.col("degree").desc(), "node_id"))
    best = F.array_sort(F.collect_list(F.when(F.col("connects") & (F.col("place") <= top), F.struct("place", "node_id"))))
    held = deg.withColumn("place", place).groupBy("case_id").agg(F.count("*").alias("nodes"), best.alias("t"))
    whole = kinds.join(held.select("case_id", "nodes", F.transform("t", lambda x: x.node_id).alias("key_connectors")), "case_id")
    return whole.withColumn("density", F.round(F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 6))
