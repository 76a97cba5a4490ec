"""Unrecognised blends: friends-of-friends on the sky, and merging of each group.

Points are put into tiles of some linking lengths, each with the points just outside, and
grouped inside each tile. Groups of tiles that share a point are joined by label propagation
with pointer jumping.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import require
from skyloom.functions.sky import ang2pix_ring
from skyloom.sources.shared import discard, materialize

#: Zero point of the merged magnitudes; bands are independent, so any would do.
ZERO_POINT = 14.0


@dataclass(frozen=True)
class BlendConfig:
    row_id: str = "row_id"
    ra: str = "ra"
    dec: str = "dec"
    linking_length: float = 1.0  # arcsec
    nside: int = 128
    bands: Sequence[str] = tuple(f"mag_{b}_lsst" for b in "ugrizy")
    ref_band: str = "mag_i_lsst"
    #: Whether size and shape are to be matched too. Declared, as in the surveyed interface, where matching isn't defined yet.
    match_size: bool = False
    match_shape: bool = False
    obj_size: str = "obj_size"
    shape_a: str = "semi_major"
    shape_b: str = "semi_minor"
    shape_theta: str = "orientation"
    redshift: str = "redshift"

    def validate(self) -> BlendConfig:
        if self.linking_length <= 0:
            raise ValueError("linking_length must be positive")
        if self.ref_band not in self.bands:
            raise ValueError("ref_band must be one of bands")
        for flag in ("match_size", "match_shape"):
            if not isinstance(getattr(self, flag), bool):
                raise TypeError(f"{flag} must be a bool")
        return self

    @property
    def matched(self) -> list[str]:
        """Columns that must be there for what is to be matched."""
        shape = [self.shape_a, self.shape_b, self.shape_theta]
        return ([self.obj_size] if self.match_size else []) + (shape if self.match_shape else [])


#: Columns that name a tile.
TILE = ("tx", "ty", "tz")


def _unit(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """Positions in degrees as points (3, n) on the unit sphere."""
    lon, lat = np.radians(ra), np.radians(dec)
    return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)))


def _chord(link: float) -> float:
    """The chord of an angle in degrees, a little longer than rounding of positions takes."""
    return 2.0 * math.sin(math.radians(min(link, 180.0)) / 2.0) * (1.0 + 1e-9) + 4e-15


def _tile_side(chord: float) -> float:
    """32 chords where that is small on the sky, 4 at least."""
    return max(4.0 * chord, min(32.0 * chord, 2.0**-6))


def _tiles(link: float):
    """Send each point to its own tile (a cube of space), and to others within a chord of it."""
    chord = _chord(link)
    side = _tile_side(chord)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = _unit(batch.column("ra").to_numpy(), batch.column("dec").to_numpy())
            own, low, high = (np.floor((at + d) / side).astype(np.int64) for d in (0.0, -chord, chord))
            row, tile = [], []
            for steps in itertools.product((0, 1), repeat=3):
                step = np.array(steps)[:, None]
                # A side spans four chords, so a point reaches one tile more at most in each direction.
                there = np.where(step == 1, np.where(low < own, low, high), own)
                here = np.flatnonzero(((step == 0) | (there != own)).all(axis=0))
                row.append(here)
                tile.append(there[:, here])
            out = batch.take(pa.array(np.concatenate(row)))
            tile = [pa.array(t) for t in np.concatenate(tile, axis=1)]
            yield pa.RecordBatch.from_arrays([*out.columns, *tile], ["id", "ra", "dec", *TILE])

    return run


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the sets of a[i] and b[i] are joined; the least number is the root of a set."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(root, b, a)
        while len(a) and not np.array_equal(up := root[root], root):
            root = up
    return root


#: Points of whole tiles that are linked together, and comparisons held at once.
TILE_POINTS, COMPARED = 200_000, 2_000_000
#: Steps to cells around a cell, one of each two opposite ones, the nearest first.
STEPS = sorted((s for s in itertools.product(range(-2, 3), repeat=3) if s > (0, 0, 0)), key=lambda s: sum(x * x for x in s))


class _Near:
    """Whether two sets of points have a pair at most the linking length apart."""

    def __init__(self, ra: np.ndarray, dec: np.ndarray, xyz: np.ndarray, link: float):
        self.lon, self.lat, self.xyz, self.link, self.chord = np.radians(ra), np.radians(dec), xyz, link, _chord(link)
        self.ra, self.dec = ra, dec

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = self.xyz[:, i] - self.xyz[:, j]
        close = np.flatnonzero((d * d).sum(axis=0) <= self.chord * self.chord)
        i, j = i[close], j[close]
        a = np.sin(np.radians(self.dec[j] - self.dec[i]) / 2) ** 2 + np.cos(self.lat[i]) * np.cos(self.lat[j]) * np.sin(np.radians(self.ra[j] - self.ra[i]) / 2) ** 2
        out = np.zeros(d.shape[1], bool)
        out[close] = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(a, 1.0)))) <= self.link
        return out

    def sets(self, i: np.ndarray, j: np.ndarray) -> bool:
        """For crowded cells: sets are halved until their boxes decide, near halves first."""
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            if len(i) * len(j) <= 4096:
                if self.pairs(np.repeat(i, len(j)), np.tile(j, len(i))).any():
                    return True
                continue
            p, q = self.xyz[:, i], self.xyz[:, j]
            low, high = (p.min(axis=1), q.min(axis=1)), (p.max(axis=1), q.max(axis=1))
            gap = np.maximum(np.maximum(low[1] - high[0], low[0] - high[1]), 0.0)
            if (gap * gap).sum() > self.chord * self.chord:
                continue
            if self.pairs(i[:1], j[:1])[0]:
                return True
            if len(i) < len(j):
                i, j, p, low, high = j, i, q, low[::-1], high[::-1]
            axis = int((high[0] - low[0]).argmax())
            by = np.argsort(p[axis], kind="stable")
            halves = [i[by[: len(by) // 2]], i[by[len(by) // 2 :]]]
            if low[1][axis] + high[1][axis] > low[0][axis] + high[0][axis]:
                halves.reverse()
            todo += [(halves[1], j), (halves[0], j)]
        return False


def _link_tiles(tile: np.ndarray, ra: np.ndarray, dec: np.ndarray, link: float) -> np.ndarray:
    """A number for each point that the points of its tile connected with it share. Points come by tile.

    A cell's diagonal is a chord, so its points are one set. Sets of cells up to two steps apart
    are joined if they have a pair near enough; pairs of joined sets aren't compared.
    """
    xyz = _unit(ra, dec)
    near = _Near(ra, dec, xyz, link)
    chord = 2.0 * math.sin(math.radians(min(link, 180.0)) / 2.0)
    cell_side = max((chord * (1.0 - 1e-9) - 4e-15) / math.sqrt(3.0), 4e-15)
    side = _tile_side(near.chord)
    bits = int(math.ceil(math.log2((side + 2.0 * near.chord) / cell_side + 12.0)))
    key = np.concatenate(([0], np.cumsum((tile[:, 1:] != tile[:, :-1]).any(axis=0))))
    for axis in range(3):
        start = tile[axis] * side - near.chord
        key = (key << bits) | (np.floor((xyz[axis] - start) / cell_side).astype(np.int64) + 4)
    by = np.argsort(key, kind="stable")
    cells, first, cell = np.unique(key[by], return_index=True, return_inverse=True)
    count = np.diff(np.append(first, len(by)))
    root = np.arange(len(cells))
    for x, y, z in STEPS:
        want = cells + ((x << 2 * bits) + (y << bits) + z)
        at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        a = np.flatnonzero((cells[at] == want) & (root[at] != root))
        b = at[a]
        size = count[a] * count[b]
        joined = np.zeros(len(a), bool)
        for k in np.flatnonzero(size > 4096):
            joined[k] = near.sets(by[first[a[k]] : first[a[k]] + count[a[k]]], by[first[b[k]] : first[b[k]] + count[b[k]]])
        few = np.flatnonzero(size <= 4096)
        for part in np.split(few, np.searchsorted(np.cumsum(size[few]), np.arange(COMPARED, size[few].sum(), COMPARED))):
            owner = np.repeat(part, size[part])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            i, j = np.divmod(nth, count[b[owner]])
            joined[owner[near.pairs(by[first[a[owner]] + i], by[first[b[owner]] + j])]] = True
        root = _hook(root, a[joined], b[joined])
    out = np.empty(len(by), np.int64)
    out[by] = root[cell]
    return out


def _stars(link: float):
    """(a, b): the least id that an id is connected with in a tile. Rows come by tile."""

    def linked(table):
        import pyarrow as pa

        *tile, ra, dec = (table.column(c).to_numpy() for c in (*TILE, "ra", "dec"))
        ids, rank = np.unique(table.column("id").to_numpy(), return_inverse=True)
        label = _link_tiles(np.stack(tile), ra, dec, link)
        least = np.full(label.max() + 1, len(ids))
        np.minimum.at(least, label, rank)
        head = least[label]
        apart = np.flatnonzero(head != rank)
        kind = table.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array(ids[head[apart]], kind), pa.array(ids[rank[apart]], kind)], ["a", "b"])

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < TILE_POINTS:
                continue
            table = pa.Table.from_batches(held)
            tile = np.stack([table.column(c).to_numpy() for c in TILE])
            other = np.flatnonzero((tile != tile[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last tile may go on
            if cut:
                yield linked(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), 0
        if held and sum(b.num_rows for b in held):
            yield linked(pa.Table.from_batches(held))

    return run


def close_pairs(df: DataFrame, cfg: BlendConfig) -> DataFrame:
    """(a, b), a < b: links that connect the same ids as all pairs at most the linking length apart do.

    Space is cut into cubes (tiles) of some linking lengths. A point goes to its tile and to those
    that it is within a linking length of, so both points of each pair meet in a tile. There groups
    are found in arrays, and each point is linked with the least id of its group. So the links
    are about as many as the points, however densely they lie.
    """
    link = cfg.linking_length / 3600.0
    points = df.select(F.col(cfg.row_id).alias("id"), F.pmod(F.col(cfg.ra), F.lit(360.0)).alias("ra"), F.col(cfg.dec).alias("dec")).where(
        F.col("id").isNotNull() & ~F.isnan("ra") & ~F.isnan("dec") & (F.abs("dec") <= 90)
    )
    kind = points.schema["id"].dataType.simpleString()
    tiled = points.mapInArrow(_tiles(link), f"id {kind}, ra double, dec double, tx long, ty long, tz long")
    rows = tiled.repartition(*TILE).sortWithinPartitions(*TILE)
    return rows.mapInArrow(_stars(link), f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id) of every id in the edges (a < b): the least id that it is connected to.

    An id that is no edge's ``a`` hangs on the least of its own; its other edges link that one with theirs.
    So only the others are labelled, in one task if their edges are few, else by label propagation.
    """
    edges = materialize(edges, "edges")
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    heads = edges.select(F.col("a").alias("head")).distinct()
    across = edges.join(least, "b").where("a <> m").select(F.least("m", "a").alias("a"), F.greatest("m", "a").alias("b"))
    between = least.join(heads, F.col("b") == F.col("head")).select(F.col("m").alias("a"), "b")
    core = materialize(across.union(between).distinct(), "core")
    core = _gathered(core) if core.limit(GATHERED + 1).count() <= GATHERED else _propagated(core)
    inner = heads.join(core, F.col("head") == F.col("id"), "left").select("head", F.coalesce("group_id", "head").alias("group_id"))
    hanging = least.join(heads, F.col("b") == F.col("head"), "left_anti").join(inner, F.col("m") == F.col("head"))
    return inner.select(F.col("head").alias("id"), "group_id").union(hanging.select("b", "group_id"))


#: Edges that one task labels, in arrays of some tens of megabytes.
GATHERED = 1_000_000


def _gathered(edges: DataFrame) -> DataFrame:
    """:func:`components` of few edges in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, place = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        root = _hook(np.arange(len(ids)), *np.split(place, 2))
        own = table.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, own), pa.array(ids[root], own)], ["id", "group_id"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, group_id {kind}")


def _propagated(edges: DataFrame) -> DataFrame:
    """:func:`components` by label propagation.

    A round gives every id the least label around it and then the label's own label. Each
    round is written to the shared folder, so that lineage doesn't grow.
    """
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    written = labels
    while True:
        around = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("l").alias("m"))
        hooked = labels.join(around, F.col("id") == F.col("a")).select("id", "l", F.least("l", "m").alias("m"))
        up = hooked.select(F.col("id").alias("p"), F.col("m").alias("up"))
        new = materialize(
            hooked.join(up, F.col("m") == F.col("p")).select("id", F.col("l").alias("was"), F.least("m", "up").alias("l")), "labels"
        )
        changed = new.where("l < was").limit(1).count()
        discard(written)
        labels, written = new.select("id", "l"), new
        if not changed:
            discard(both)
            return labels.withColumnRenamed("l", "group_id")


def friends_of_friends(df: DataFrame, cfg: BlendConfig = BlendConfig()) -> DataFrame:
    """row id and group_id (the least row id of the group) of every row; a lone row is its own group.

    Rows at one position are one point with the least of their ids, so many rows at one place
    (a default position, a catalog twice) make no pairs. Rows without a position are alone.
    """
    cfg.validate()
    require(df, [cfg.row_id, cfg.ra, cfg.dec, *cfg.matched])
    ra, dec = F.col(cfg.ra).cast("double"), F.col(cfg.dec).cast("double")
    placed = df.select(
        F.col(cfg.row_id).alias("__id"),
        # 0 and -0 are one place
        (F.pmod(ra, F.lit(360.0)) + 0.0).alias("__ra"),
        (dec + 0.0).alias("__dec"),
        F.coalesce(~F.isnan(ra) & ~F.isnan(dec) & (F.abs(dec) <= 90) & (F.abs(ra) < F.lit(float("inf"))), F.lit(False)).alias("__ok"),
    )
    points = materialize(placed.where("__ok").groupBy("__ra", "__dec").agg(F.min("__id").alias("__point")), "points")
    edges = close_pairs(points.select(F.col("__point").alias(cfg.row_id), F.col("__ra").alias(cfg.ra), F.col("__dec").alias(cfg.dec)), cfg)
    groups = components(edges).select(F.col("id").alias("__point"), "group_id")
    grouped = points.join(groups, "__point", "left").select("__ra", "__dec", F.coalesce("group_id", "__point").alias("__group"))
    with_group = placed.where("__ok").join(grouped, ["__ra", "__dec"]).select(F.col("__id").alias(cfg.row_id), F.col("__group").alias("group_id"))
    return with_group.union(placed.where("not __ok").select(F.col("__id").alias(cfg.row_id), F.col("__id").alias("group_id")))


def merge_groups(df: DataFrame, groups: DataFrame, cfg: BlendConfig = BlendConfig()) -> DataFrame:
    """One row a group: mean position, summed fluxes as magnitudes, and redshift statistics.

    hpx_idx and redshift are those of the member with the largest reference flux (of equals,
    the least row id).
    """
    require(df, [cfg.row_id, cfg.ra, cfg.dec, cfg.redshift, *cfg.bands])
    flux = lambda b: F.pow(F.lit(10.0), -0.4 * (F.col(b) - ZERO_POINT))
    rows = df.join(groups, cfg.row_id).withColumns(
        {f"__f{k}": flux(b) for k, b in enumerate(cfg.bands)}
        | {"__ref": flux(cfg.ref_band), "__pix": ang2pix_ring(F.col(cfg.ra), F.col(cfg.dec), cfg.nside)}
    )
    z = F.col(cfg.redshift)
    best = F.max_by(F.struct("__pix", z.alias("z")), F.struct(F.col("__ref"), -F.col(cfg.row_id)))
    total = F.sum("__ref")
    spread = F.coalesce(F.stddev_samp(z), F.lit(0.0))
    out = rows.groupBy("group_id").agg(
        F.avg(cfg.ra).alias(cfg.ra),
        F.avg(cfg.dec).alias(cfg.dec),
        best.alias("__best"),
        *[(-2.5 * F.log10(F.sum(f"__f{k}")) + ZERO_POINT).alias(b) for k, b in enumerate(cfg.bands)],
        F.count(F.lit(1)).alias("n_obj"),
        F.max("__ref").alias("brightest_flux"),
        total.alias("total_flux"),
        (F.sum(z * F.col("__ref")) / total).alias("z_weighted"),
        F.avg(z).alias("z_mean"),
        F.when(F.isnan(spread), 0.0).otherwise(spread).alias("z_stdev"),
    )
    return out.select(
        cfg.ra,
        cfg.dec,
        F.col("__best")["__pix"].alias("hpx_idx"),
        *cfg.bands,
        F.col("__best")["z"].alias(cfg.redshift),
        "group_id",
        "n_obj",
        "brightest_flux",
        "total_flux",
        F.col("__best")["z"].alias("z_brightest"),
        "z_weighted",
        "z_mean",
        "z_stdev",
    )


def unrecognized_blends(df: DataFrame, cfg: BlendConfig = BlendConfig()) -> dict[str, DataFrame]:
    """``output``: the merged catalog; ``components``: row id, group_id and hpx_idx of every input row."""
    groups = materialize(friends_of_friends(df, cfg), "groups")
    pixel = df.select(cfg.row_id, ang2pix_ring(F.col(cfg.ra), F.col(cfg.dec), cfg.nside).alias("hpx_idx"))
    return {"output": merge_groups(df, groups, cfg), "components": groups.join(pixel, cfg.row_id)}
