"""Knowledge and reading graphs as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import staged

# What entities, relations and reading tracks there are.
ENTITY_TYPES = ("register", "instruction", "signal", "component", "concept_term", "figure", "table")
TRACKS = ("main_flow", "caption_flow", "footnote_flow", "sidebar_flow", "annotation_flow")


def upsert_entities(rows: DataFrame) -> DataFrame:
    """rows: entity_id, name, entity_type, seq. The last one of each id."""
    return rows.groupBy("entity_id").agg(F.max_by(F.struct("name", "entity_type"), "seq").alias("e")).select("entity_id", "e.*")


def upsert_edges(rows: DataFrame) -> DataFrame:
    """rows: source_id, target_id, relation, analyzer, confidence, metadata (map), seq.

    One edge a (source, target, relation, analyzer): the last confidence, metadata merged with later keys winning, at the place of the first.
    """
    key = ("source_id", "target_id", "relation", "analyzer")
    entries = rows.select(*key, "seq", F.explode(F.coalesce("metadata", F.create_map().cast("map<string,string>")))).groupBy(*key, "key").agg(F.max_by("value", "seq").alias("value"))
    merged = entries.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    edges = rows.groupBy(*key).agg(F.max_by("confidence", "seq").alias("confidence"), F.min("seq").alias("seq"))
    same = [edges[k].eqNullSafe(merged[k]) for k in key]
    joined = edges.join(merged, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select(*(edges[k] for k in key), "confidence", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "seq")


def edges_of(edges: DataFrame, node_id: str, outgoing: bool = True, relation: str | None = None, track: str | None = None) -> DataFrame:
    found = edges.filter(F.col("source_id" if outgoing else "target_id") == node_id)
    for column, value in (("relation", relation), ("track", track)):
        found = found if value is None else found.filter(F.col(column) == value)
    return found


def dangling(edges: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id, relation, missing: an endpoint that is neither a node nor an entity, one row each."""
    known = nodes.select(F.col("node_id").alias("missing")).union(entities.select("entity_id")).distinct()
    ends = edges.select("source_id", "target_id", "relation", F.explode(F.array("source_id", "target_id")).alias("missing"))
    return ends.join(known, "missing", "left_anti").select("source_id", "target_id", "relation", "missing")


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with source_name and target_name: the entity's name, else the first 8 characters of the id."""
    names = entities.select("entity_id", "name")
    out = edges
    for end in ("source", "target"):
        out = out.join(names.select(F.col("entity_id").alias(f"_{end}"), F.col("name").alias(f"_{end}_name")), F.col(f"{end}_id") == F.col(f"_{end}"), "left").withColumn(f"{end}_name", F.coalesce(f"_{end}_name", F.left(f"{end}_id", F.lit(8)))).drop(f"_{end}", f"_{end}_name")
    return out


def first_by_track(edges: DataFrame, k: int = 100) -> DataFrame:
    """The first k edges of each track by seq."""
    return edges.withColumn("_k", F.row_number().over(Window.partitionBy("track").orderBy("seq"))).filter(F.col("_k") <= k).drop("_k")


TRACK = 200_000  # edges of a track that one task peels at once


def _peeled(track: pd.DataFrame) -> pd.DataFrame:
    """The edges of a track that are left when nodes without a way in, then those without a way out, are taken off; each edge is looked at twice."""
    for into, out in (("target_id", "source_id"), ("source_id", "target_id")):
        after: dict = {}
        for at, (x, y) in enumerate(zip(track[out], track[into])):
            after.setdefault(x, []).append((at, y))
        ways = track[into].value_counts(dropna=False).to_dict()
        gone, loose = [], [x for x in after if x not in ways]
        while loose:
            for at, y in after.get(loose.pop(), ()):
                gone.append(at)
                ways[y] -= 1
                if not ways[y]:
                    loose.append(y)
        track = track.drop(track.index[gone])
    return track


def on_cycles(edges: DataFrame, track_edges: int = TRACK) -> DataFrame:
    """Edges of each track that lie on a cycle or between cycles: what is left when nodes without a way in, and those without a way out, are peeled off again and again.

    edges: track, source_id, target_id. A track of at most `track_edges` is peeled in one task, however long its chains. Of larger ones a layer goes with each round, written to the shared folder, until nothing more goes.
    """
    rows = staged(edges, "edges")
    large = rows.groupBy(F.col("track").alias("_lt")).count().filter(F.col("count") > track_edges).select("_lt")
    large = staged(large, "large-tracks")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    same = F.col("track").eqNullSafe(F.col("_lt"))
    left = rows.join(large, same, "left_anti").groupBy("track").applyInPandas(_peeled, shape)
    if large.isEmpty():
        return staged(left, "cyclic-edges")
    rest, n = staged(rows.join(large, same, "left_semi"), "edges"), -1
    while (now := rest.count()) not in (n, 0):
        n = now
        starts = rest.select(F.col("track").alias("_t"), F.col("source_id").alias("_n")).distinct()
        ends = rest.select(F.col("track").alias("_u"), F.col("target_id").alias("_m")).distinct()
        rest = rest.join(starts, F.col("track").eqNullSafe(F.col("_t")) & F.col("target_id").eqNullSafe(F.col("_n")), "left_semi")
        rest = staged(rest.join(ends, F.col("track").eqNullSafe(F.col("_u")) & F.col("source_id").eqNullSafe(F.col("_m")), "left_semi"), "edges")
    return staged(left.unionByName(rest), "cyclic-edges")


def assert_acyclic(edges: DataFrame) -> None:
    if (bad := on_cycles(edges).limit(1).collect()):
        raise ValueError(f"cyclic reading path through {bad[0].source_id}")


class _Order:
    """A topological order that is kept while edges come (Pearce and Kelly): an edge against it only moves the nodes between its ends."""

    def __init__(self) -> None:
        self.at: dict = {}
        self.after: dict = {}
        self.before: dict = {}

    def _reached(self, start, ways: dict, beyond) -> list:
        seen, waiting = {start}, [start]
        while waiting:
            for y in ways.get(waiting.pop(), ()):
                if y not in seen and beyond(self.at[y]):
                    seen.add(y)
                    waiting.append(y)
        return sorted(seen, key=self.at.get)

    def accept(self, source, target) -> bool:
        """Whether the edge closes no cycle with those before; then it's taken in."""
        for x in (source, target):
            self.at.setdefault(x, len(self.at))
        low, high = self.at[target], self.at[source]
        if low == high:
            return False
        if low < high:
            ahead = self._reached(target, self.after, lambda k: k <= high)
            if self.at[ahead[-1]] == high:
                return False
            moved = self._reached(source, self.before, lambda k: k > low) + ahead
            for x, k in zip(moved, sorted(self.at[x] for x in moved)):
                self.at[x] = k
        self.after.setdefault(source, []).append(target)
        self.before.setdefault(target, []).append(source)
        return True


def accept_steps(edges: DataFrame) -> DataFrame:
    """edges with accepted: per document and track, in the order of seq, a step that closes a cycle with the accepted ones, or a loop, is refused.

    Each decision hangs on all before, so a document's track is one group, folded in Python with a topological order that each step mends where it must.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, order = group.sort_values("seq"), _Order()
        return group.assign(accepted=[order.accept(s, t) for s, t in zip(group["source_id"], group["target_id"])])

    rows = edges.select("doc_id", "track", "seq", "source_id", "target_id", "confidence")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("doc_id", "track").applyInPandas(fold, f"{shape}, accepted boolean")


def reading_sequence(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, track, step, node_id: from each root, always on to the unvisited target with the greatest confidence, the first of equals.

    roots: doc_id, track, node_id. The choice hangs on what was visited, so a document's track is walked as one group.
    """

    def walk(key: tuple, starts: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for r in steps.sort_values(["confidence", "seq"], ascending=[False, True]).itertuples(index=False):
            after.setdefault(r.source_id, []).append(r.target_id)
        out = []
        for root in starts["node_id"]:
            at, seen, place = root, {root}, 0
            while at is not None:
                out.append((key[0], key[1], root, place, at))
                at, place = next((t for t in after.get(at, ()) if t not in seen), None), place + 1
                seen.add(at)
        return pd.DataFrame(out, columns=["doc_id", "track", "root_id", "step", "node_id"])

    left = roots.select("doc_id", "track", "node_id").groupBy("doc_id", "track")
    right = edges.select("doc_id", "track", "source_id", "target_id", "confidence", "seq").groupBy("doc_id", "track")
    return left.cogroup(right).applyInPandas(walk, "doc_id string, track string, root_id string, step int, node_id string")


def graph_json(edges: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, edges: a document's edges as a JSON array in the order of seq."""
    one = F.struct("seq", F.struct(*fields).alias("e"))
    return edges.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"])).alias("edges"))


def boxes_to_labels(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """word_id, box_id: the smallest box around a word's centre, else the box right below that it overlaps by over 0.3 of the narrower one.

    boxes: region, box_id, x0, y0, x1, y1; words: region, word_id, x0, y0, x1, y1. A range join within a region.
    """
    b = boxes.select("region", "box_id", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = words.join(b, "region")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1"))
    width = F.least(F.col("x1") - F.col("x0"), F.col("bx1") - F.col("bx0"))
    overlap = F.when(width > 0, (F.least("x1", "bx1") - F.greatest("x0", "bx0")) / width).otherwise(0.0)
    above = ~inside & (F.col("y1") <= F.col("by0")) & (overlap > 0.3)
    rank = F.when(inside, F.struct(F.lit(0).alias("k"), ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))).alias("v"), "box_id")).when(above, F.struct(F.lit(1).alias("k"), (F.col("by0") - F.col("y1")).alias("v"), "box_id"))
    return pairs.groupBy("region", "word_id").agg(F.min(rank).alias("r")).filter("r is not null").select("region", "word_id", "r.box_id")


def innermost_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that enclose no other box of their region."""
    a = boxes.alias("a")
    inner = boxes.select("region", F.col("box_id").alias("_i"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1"))).alias("i")
    holds = (F.col("a.region") == F.col("i.region")) & (F.col("a.box_id") != F.col("_i")) & (F.col("x0") <= F.col("_x0")) & (F.col("y0") <= F.col("_y0")) & (F.col("x1") >= F.col("_x1")) & (F.col("y1") >= F.col("_y1"))
    return a.join(inner, holds, "left_anti")


#: Fixed value: boxes that differ by less in place and size are one.
NEAR = 12


def distinct_boxes(boxes: DataFrame, near: float = NEAR) -> DataFrame:
    """boxes without those that differ by less than `near` in x, y, width and height from a larger one that stays; of equal areas the smaller box_id is first.

    boxes: region, box_id, x0, y0, x1, y1, in pixels. Whether a box stays hangs on the larger ones that stay, so a region is folded as one.
    """
    one = F.struct((-(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), "box_id", "x0", "y0", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    alike = lambda a, b: (F.abs(a["x0"] - b["x0"]) < near) & (F.abs(a["y0"] - b["y0"]) < near) & (F.abs(a["w"] - b["w"]) < near) & (F.abs(a["h"] - b["h"]) < near)
    regions = boxes.groupBy("region").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda out, b: F.when(F.exists(out, lambda o: alike(o, b)), out).otherwise(F.concat(out, F.array(b))))
    stay = regions.select(F.col("region").alias("_r"), F.explode(F.transform(kept, lambda b: b["box_id"])).alias("_b"))
    return boxes.join(stay, (F.col("region") == F.col("_r")) & (F.col("box_id") == F.col("_b")), "left_semi")


def tikz(boxes: DataFrame, labels: DataFrame, arrows: DataFrame, width: float = 15.0, height: float = 23.0) -> DataFrame:
    """region, tikz: boxes, labels and arrows of a region, scaled to centimetres, y upwards."""
    x, y = (lambda c: F.format_number(c * width, 2)), (lambda c: F.format_number((1 - c) * height, 2))
    draw = boxes.select("region", F.lit(0).alias("o"), "box_id", F.format_string(r"\draw (%s,%s) rectangle (%s,%s);", x(F.col("x0")), y(F.col("y0")), x(F.col("x1")), y(F.col("y1"))).alias("line"))
    write = labels.select("region", F.lit(1).alias("o"), "box_id", F.format_string(r"\node at (%s,%s) {%s};", x((F.col("x0") + F.col("x1")) / 2), y((F.col("y0") + F.col("y1")) / 2), F.col("text")).alias("line"))
    point = arrows.select("region", F.lit(2).alias("o"), F.col("from_id").alias("box_id"), F.format_string(r"\draw[->] (%s,%s) -- (%s,%s);", x(F.col("x0")), y(F.col("y0")), x(F.col("x1")), y(F.col("y1"))).alias("line"))
    lines = draw.unionByName(write).unionByName(point)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "box_id", "line"))), lambda e: e["line"]), "\n")
    return lines.groupBy("region").agg(F.concat(F.lit("\\begin{tikzpicture}\n"), body, F.lit("\n\\end{tikzpicture}")).alias("tikz"))


def tikz_of_reply(reply):
    """What a model's reply has between the begin and end marks."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\\begin\{tikzpicture\}.*?\\end\{tikzpicture\})", 1), F.lit(""))
