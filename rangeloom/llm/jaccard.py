"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

Two sets with Jaccard similarity of 0.8 or more differ in at most (a + b) / 9 shingles. Sizes fall into bands whose
bounds grow by a quarter, so that a linking pair lies in one band or two neighbouring ones; each band k has an instance
for pairs whose smaller set lies in it, with a bound H on their difference. The instance deals the universe of shingles
into m > H segments by a hash: at least m - H segments of a linking pair are equal. Each set is indexed by the sums of
its non-empty segments' shingle hashes. m is chosen by cost: the fewest segments (the fewest entries and the most
selective ones) of which all but rare sets fill more than H, since then an equal segment that is not empty must exist.
For pairs of the rare sets with too many empty segments, the first D segments are indexed with their one-deletion
neighbourhoods as well, each of which pays for two differences; D grows with the deficit until it is m.

Entries meet in buckets of bounded size. An entry that very many sets of one task share is handed on as a list part of
that task and leaves a mark in its bucket, so that no bucket gathers a hot entry. Sets that share an entry form a list;
lists that overlap for the most part become one, long lists stay in parts. Within a part, parity sketches bound each
pair's difference from below, and only pairs that may link are verified: at first each set's nearest few, which merges
near copies into components; then one member of each component of the lists with several parts; then the rest across
components, as pairs, or as blocks of sets where they are dense. So large groups of near copies or documents that share
a passage cost neither all their pairs as rows nor any lost link. Equal sets are one node from the start. Nothing is
capped, sampled or dropped.

Verification goes by units of a bounded number of shingles: a unit gets each text it needs once, compares full 64-bit
hashes of shingles, and near 80 percent the words themselves. Files that a later step no longer needs are deleted.

Defined results: words are what ASCII white space leaves, with A-Z in lower case; fewer than five words are one shingle
as a whole; a null or empty text, or one of white space, has no shingle and links with nothing. Rows of the same id are
one vertex. A null id takes no part: its row returns with a null component. An empty table gives no rows. Other columns
are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import discard, written
from rangeloom.llm.components import components

WIDTH = 5
#: Cells of a parity sketch at least and at most, entries of a bucket (a task's memory), entries gathered before a task
#: hands them on, sets of one task that make an entry a hot one, members of a list part and of a task that handles many
#: parts, the nearest partners that a set proposes at first, shingles of a verification unit, and of a group's pairs for
#: each of its sets those that make it dense.
LEAST_CELLS, CELLS, BUCKET, FLUSH, HOT, PART, CHUNK, NEAREST, UNIT, DENSE, BLOCK = 256, 8192, 3_000_000, 1_500_000, 256, 2048, 20_000, 3, 400_000, 64, 256
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MARK = np.iinfo("int64").min


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, "uint64")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    span, total = min(width, len(words)), np.full(max(1, len(words) - width + 1), min(width, len(words)), "uint64")
    for k in range(span):
        total = mix(total * _GOLD + hashes[k : k + len(total)])
    return np.unique(total)


def plain_shingles(text: str | None, width: int = WIDTH) -> frozenset[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = words_of(text)
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def name_of(own: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(np.add.reduce(mix(own ^ _M1), dtype="uint64").astype("int64"))


@lru_cache(maxsize=1)
def _bounds() -> list[int]:
    """The least size of each band; a linking partner of a band's set lies in it or the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return out


@lru_cache(maxsize=None)
def plan(k: int) -> tuple[int, int, int, tuple[int, ...]]:
    """Instance k: bound on the difference, segments, largest size, and D of each level for sets with many empty segments."""
    low, high = _bounds()[k], _bounds()[k + 1] - 1
    h = (high + high * 5 // 4) // 9
    m = h + 1
    while h and m - h - 1 < m * np.exp(-low / m) + 2 * np.sqrt(m * np.exp(-low / m)) and m < 4 * h + 4:
        m += max(1, m // 64)
    levels = tuple(dict.fromkeys((min(m, max(2, m // 10)), min(m, max(2, m // 3)), m)))
    return h, m, high * 5 // 4, levels


def entries(own: np.ndarray) -> np.ndarray:
    """The 64-bit index entries of a set: two linking sets share one at least."""
    n, out = len(own), []
    if not n:
        return np.zeros(0, "uint64")
    band = int(np.searchsorted(_bounds(), n, "right")) - 1
    for k in (band, band - 1):
        if k < 0:
            continue
        h, m, largest, levels = plan(k)
        if n > largest:
            continue
        salt = np.uint64((k + 1) * int(_GOLD) % (1 << 64))
        hashes = mix(own ^ salt)
        segment = ((hashes >> np.uint64(32)) % np.uint64(m)).astype("int64")
        order = np.argsort(segment, kind="stable")
        segment, hashes = segment[order], hashes[order]
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums, filled = np.add.reduceat(hashes, starts), segment[starts]
        tag = lambda value, at, level: mix(value + mix(at.astype("uint64") * _M1 + salt + np.uint64(level * int(_M2) % (1 << 64))))
        out.append(tag(sums, filled, 0))
        empty, before = m - len(starts), 0
        for level, d in enumerate(levels, 1):
            if empty <= m - h - 1 + before:
                break  # of any pair, the set with fewer empty segments decides
            full = np.zeros(d, "uint64")
            full[filled[filled < d]] = sums[filled < d]
            inside = segment < d
            out += [tag(full, np.arange(d), level), tag(full[segment[inside]] - hashes[inside], segment[inside], level)]
            before = d
    return np.concatenate(out)


def cells_for(n: int) -> int:
    """Cells of the sketch of a set of n: near n, so that the difference of a linking pair does not fill them."""
    return min(CELLS, max(LEAST_CELLS, 1 << max(n - 1, 1).bit_length()))


def parity(own: np.ndarray, cells: int = 2048) -> bytes:
    """Parities of the shingle counts in the cells: sketches differ in no more cells than sets do in shingles."""
    return np.packbits((np.bincount((own % np.uint64(cells)).astype("int64"), minlength=cells) & 1).astype("uint8")).tobytes()


def folded(sketch: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (rows of bytes) folded to fewer cells: they still bound the difference from below."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, cells // 8), axis=1)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, sketch = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingles(text)
            n.append(len(own))
            one.append(name_of(own))
            two.append(np.bitwise_xor.reduce(mix(own ^ _M2), dtype="uint64").astype("int64") if len(own) else 0)
            sketch.append(parity(own, cells_for(len(own))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n", "one", "two", "sketch"])


def _low6(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view("uint8").reshape(-1, 8)[:, :6]


def _list_key(value: int, bucket: int) -> int:
    """A hot entry's list: the same wherever its sets come from."""
    return xxhash.xxh3_64_intdigest(f"{value & ((1 << 48) - 1)}:{bucket}") - (1 << 63)


def _index(buckets: int):
    """Entries of each distinct set that a task sees, packed by bucket: 6 bytes an entry, and each set's name once.

    Rows of a hot entry's list parts have its list instead of entries, and any bucket.
    """

    def packed(gathered: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        values = np.concatenate([e for _, e in gathered])
        names = np.array([name for name, _ in gathered] + [_MARK], "int64")
        sets = np.repeat(np.arange(len(gathered)), [len(e) for _, e in gathered])
        bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("int64")
        order = np.lexsort((values, bucket))
        values, sets, bucket = values[order], sets[order], bucket[order]
        rows: list[list] = [[], [], [], [], []]
        runs = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
        hot = np.flatnonzero(np.diff(runs) >= HOT)
        keep = np.ones(len(values), bool)
        for k in hot:
            a, b = runs[k], runs[k + 1]
            own = np.unique(sets[a:b])
            if len(own) < HOT:
                continue
            key = _list_key(int(values[a]), int(bucket[a]))
            for at in range(0, len(own), PART):
                part = names[own[at : at + PART]].tobytes()
                for column, value in zip(rows, (xxhash.xxh3_64_intdigest(part) % buckets, key, part, b"", b"")):
                    column.append(value)
            keep[a + 1 : b] = False
            sets[a] = len(names) - 1
        values, sets, bucket = values[keep], sets[keep], bucket[keep]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            order = np.argsort(sets[a:b], kind="stable")
            own, counts = np.unique(sets[a:b], return_counts=True)
            for column, value in zip(rows, (int(bucket[a]), None, names[own].tobytes(), counts.astype("uint32").tobytes(), _low6(values[a:b][order]).tobytes())):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[2:])], ["bucket", "list", "names", "counts", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[int, np.ndarray]] = []
        held, seen = 0, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(text)
                name = name_of(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                gathered.append((name, entries(own)))
                held += len(gathered[-1][1])
                if held >= FLUSH:
                    yield packed(gathered)
                    gathered, held, seen = [], 0, set()
        if gathered:
            yield packed(gathered)

    return run


def _unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), "uint8")
    out[:, :6] = np.frombuffer(raw, "uint8").reshape(-1, 6)
    return out.view("uint64").ravel()


def gathered_lists(lists: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Fewer lists that hold each of the given ones: a list joins the one that holds more than half of it, up to ``most`` members."""
    groups: list[set[int]] = []
    latest: dict[int, int] = {}
    for own in sorted(lists, key=len, reverse=True):
        members = own.tolist()
        near: dict[int, int] = {}
        for x in members:
            if x in latest:
                near[latest[x]] = near.get(latest[x], 0) + 1
        at = max(near, key=lambda g: (near[g], -g)) if near else -1
        if at >= 0 and (near[at] == len(members) or 2 * near[at] > len(members) and len(groups[at]) + len(members) - near[at] <= most):
            groups[at].update(members)
        else:
            groups.append(set(members))
            at = len(groups) - 1
        for x in members:
            latest[x] = at
    return [np.sort(np.fromiter(g, "int64", len(g))) for g in groups]


def _lists(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Lists of sets that share an entry, in parts: list, part (0 of a list in one), several (whether it has parts elsewhere or more than one), names."""
    direct = rows[rows["list"].notna()]
    out = [(int(k), xxhash.xxh3_64_intdigest(p) >> 1 | 1, True, np.frombuffer(p, "int64")) for k, p in zip(direct["list"], direct["names"])]
    rows = rows[rows["list"].isna()]
    names = np.concatenate([np.repeat(np.frombuffer(n, "int64"), np.frombuffer(c, "uint32")) for n, c in zip(rows["names"], rows["counts"])] or [np.zeros(0, "int64")])
    values = np.concatenate([_unpack6(e) for e in rows["entries"]] or [np.zeros(0, "uint64")])
    order = np.lexsort((names, values))
    names, values = names[order], values[order]
    first = np.r_[True, (values[1:] != values[:-1]) | (names[1:] != names[:-1])] if len(values) else np.zeros(0, bool)
    names, values = names[first], values[first]
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, int)
    seen: dict[bytes, np.ndarray] = {}

    def parts(name: int, own: np.ndarray) -> None:
        for k in range(0, len(own), PART):
            part = own[k : k + PART]
            out.append((name, xxhash.xxh3_64_intdigest(part.tobytes()) >> 1 | 1, True, part))

    for k in np.flatnonzero(np.diff(cuts) > 1):
        own = names[cuts[k] : cuts[k + 1]]
        if own[0] == _MARK:
            parts(_list_key(int(values[cuts[k]]), int(key[0])), own[1:])
        else:
            seen.setdefault(own.tobytes(), own)
    for own in seen.values():
        if len(own) > PART:
            parts(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), own)
    for own in gathered_lists([own for own in seen.values() if len(own) <= PART], PART):
        out.append((xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), 0, False, own))
    return pd.DataFrame(out, columns=["list", "part", "several", "names"])


def _regather(rows: pd.DataFrame) -> pd.DataFrame:
    """Lists that overlap for the most part become one; those of one group of near copies mostly share their first member."""
    groups = gathered_lists([np.asarray(own) for own in rows["names"]], PART)
    return pd.DataFrame({"list": [xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) for own in groups], "part": 0, "several": False, "names": groups})


def _may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in so many shingles at least can still link."""
    return (9 * differ <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _of_list(n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: list[bytes], nearest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of one list part that may link across components (at most ``nearest`` partners of each set, or
    all), and of the sets that have more partners. A pair left out has two of those, since each set picks its nearest."""
    cells = np.array([8 * len(s) for s in sketches])
    found, more = [(np.zeros(0, "int64"), np.zeros(0, "int64"))], [np.zeros(0, "int64")]
    two = side.any()
    for c in np.unique(cells):
        # linking sizes are a quarter apart at most, so sketches of a pair have the same length or one has twice the other's
        own = np.flatnonzero((cells == c) | (cells == 2 * c))
        bits = np.empty((len(own), c // 8), "uint8")
        for length in (c, 2 * c):
            at = np.flatnonzero(cells[own] == length)
            if len(at):
                bits[at] = folded(np.frombuffer(b"".join(sketches[k] for k in own[at]), "uint8").reshape(len(at), -1), c)
        signs = 1 - 2 * np.unpackbits(bits, axis=1).astype("float32")
        least = cells[own] == c
        left, right = (np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)) if two else (np.arange(len(own)), np.arange(len(own)))
        for start in range(0, len(left), 512):
            x = left[start : start + 512]
            differ = (c - signs[x] @ signs[right].T) / 2
            a, b = own[x], own[right]
            may = _may_link(n[a][:, None], n[b][None, :], differ) & (comp[a][:, None] != comp[b][None, :]) & (least[x][:, None] | least[right][None, :])
            if nearest and len(right) > nearest:
                more.append(a[may.sum(axis=1) > nearest])
                differ = np.where(may, differ, np.inf)
                at = np.argpartition(differ, nearest - 1, axis=1)[:, :nearest]
                i, j = np.repeat(np.arange(len(x)), nearest), at.ravel()
                good = may[i, j]
                i, j = i[good], j[good]
            else:
                i, j = np.nonzero(may)
            found.append((a[i], b[j]))
    return *(np.concatenate(c) for c in zip(*found)), np.unique(np.concatenate(more))


_WORK = "unit long, a long, a_name long, b long, b_name long, side int"


def _propose(nearest: int | None):
    """Of many list parts, what to verify: pairs that may link across components (each set's nearest few, or all), and
    blocks of sets (side 0 against side 1; b is the component) where pairs are dense. Dealt into units. Rows of side -2
    are the sets with further partners: unit is the list, b the part, b_name the size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "part", "side", "component", "node", "one"], ignore_index=True)
        name, part, n, node, one, comp, side = (rows[c].to_numpy() for c in ("list", "part", "n", "node", "one", "component", "side"))
        sketches = rows["sketch"].tolist()
        cuts = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (part[1:] != part[:-1]), True])
        found, blocks, further = [(np.zeros(0, "int64"), np.zeros(0, "int64"))], [], [np.zeros(0, "int64")]
        seed = (int(name[0]) ^ int(part[0])) & ((1 << 62) - 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2 or comp[a:b].min() == comp[a:b].max():
                continue
            i, j, more = _of_list(n[a:b], comp[a:b], side[a:b], sketches[a:b], nearest)
            further.append(more + a)
            if nearest is None and len(i) > DENSE * (b - a):
                halves = [np.arange(a, b)[side[a:b] == s] for s in (0, 1)] if side[a:b].any() else [np.arange(a, b)] * 2
                lefts, rights = ([h[k : k + BLOCK] for k in range(0, len(h), BLOCK)] for h in halves)
                blocks += [(x, y) for p, x in enumerate(lefts) for q, y in enumerate(rights) if side[a:b].any() or q >= p]
            else:
                found.append((i + a, j + a))
        x, y = (np.concatenate(c) for c in zip(*found))
        swap = (node[x] > node[y]) | ((node[x] == node[y]) & (one[x] > one[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        unit = seed + np.cumsum(n[x] + n[y]) // UNIT
        out = [pd.DataFrame({"unit": unit, "a": node[x], "a_name": one[x], "b": node[y], "b_name": one[y], "side": np.full(len(x), -1)})]
        out[0] = out[0].drop_duplicates(["a", "a_name", "b", "b_name"])
        at = np.concatenate(further)
        out.append(pd.DataFrame({"unit": name[at], "a": node[at], "a_name": one[at], "b": part[at], "b_name": n[at], "side": np.full(len(at), -2)}))
        for k, sides in enumerate(blocks):
            for s, at in enumerate(sides):
                out.append(pd.DataFrame({"unit": np.full(len(at), seed - 1 - k), "a": node[at], "a_name": one[at], "b": comp[at], "b_name": np.zeros(len(at), "int64"), "side": np.full(len(at), s)}))
        return pd.concat(out).astype({"unit": "int64", "a": "int64", "a_name": "int64", "b": "int64", "b_name": "int64", "side": "int32"})

    return run


def _needed_bits(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A one-hash filter of the ids, at most 2**26 bits: it only spares shuffling texts; a join decides."""
    bits = min(26, max(12, (16 * max(n, 1)).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(at % 64 AS int))")
    words = ids.select(at.alias("at")).select(F.expr("cast(at div 64 AS int)").alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    out = np.zeros(1 << max(bits - 6, 0), "int64")
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out, bits


class Unit:
    """The sets of a verification unit, and exact comparisons of them."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.texts, self.sets, self.plain = {}, {}, {}
        for i, text in zip(ids, texts):
            own = shingles(text)
            key = i, name_of(own)
            if key not in self.sets:
                self.sets[key], self.texts[key] = own, text

    def exactly(self, x: tuple, y: tuple, percent: int) -> bool:
        for key in (x, y):
            if key not in self.plain:
                self.plain[key] = plain_shingles(self.texts[key])
        a, b = self.plain[x], self.plain[y]
        common = len(a & b)
        return 100 * common >= percent * (len(a) + len(b) - common)

    def partners(self, x: tuple, others: list[tuple], percent: int = 80) -> list[tuple]:
        """Those of the others that link with x."""
        own, sets = self.sets[x], [self.sets[y] for y in others]
        if not others:
            return []
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        ends = np.cumsum([len(s) for s in sets])
        common = np.diff(np.r_[0, np.cumsum(own[at] == flat)[ends - 1]])
        union = len(own) + np.diff(np.r_[0, ends]) - common
        over = 100 * common - percent * union
        # two hashes that fall together may move a pair over the edge: there the words decide
        return [y for y, o in zip(others, over) if (self.exactly(x, y, percent) if abs(o) <= 400 else o > 0)]


def _check(key: tuple, work: pa.Table, texts: pa.Table) -> pa.Table:
    """The links among a unit's pairs, and links that join the components of its blocks as all links would."""
    unit, found = Unit(texts["id"].to_pylist(), texts["text"].to_pylist()), []
    pairs: dict[tuple, list[tuple]] = {}
    sides: tuple[dict, dict] = ({}, {})
    for a, a_name, b, b_name, side in zip(*(work[c].to_pylist() for c in ("a", "a_name", "b", "b_name", "side"))):
        if side < 0:
            pairs.setdefault((a, a_name), []).append((b, b_name))
        else:
            sides[side][a, a_name] = b
    for x, others in pairs.items():
        found += [(x[0], y[0]) for y in unit.partners(x, others)]
    parent: dict = {}

    def root(c):
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for x, c in sides[0].items():
        others = [y for y, d in sides[1].items() if root(d) != root(c)]
        for y in unit.partners(x, others):
            if root(sides[1][y]) != root(c):
                parent[root(sides[1][y])] = root(c)
                found.append((x[0], y[0]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _verified(work: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the pairs and blocks of work."""
    sides = work.select("unit", F.col("a").alias("id")).unionByName(work.filter("side < 0").select("unit", F.col("b").alias("id")))
    needs = written(sides.distinct())
    ids = needs.select("id").distinct()
    filter_bits, bits = _needed_bits(ids, needs.count())
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((words[at >> 6] >> (at & 63)) & 1 == 1)).select([0, 1])

    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").select("id", "text", at.alias("at")).mapInArrow(needed, "id long, text string")
    # the same plan at every size; a set that many units need is dealt by its id and salt
    own = needs.hint("merge").join(texts, "id").select("unit", "id", "text")
    found = written(work.groupBy("unit").cogroup(own.groupBy("unit")).applyInArrow(_check, "a long, b long").filter("a <> b").distinct())
    discard(needs)
    return found


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows of one id with different texts."""
    repeated = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    own = known.join(repeated, "doc_id", "left_semi").select("doc_id", "one", "two", "n").distinct().join(classes, ["one", "two", "n"])
    return own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()


def _joined(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of lists: list, part, several, node, one, n."""
    flat = lists.select("list", "part", "several", F.explode("names").alias("one"))
    return flat.join(classes.select("one", "node", "n"), "one").select("list", "part", "several", "node", "one", "n")


class Search:
    """The rounds of proposals: links found so far as components, and what is still open."""

    def __init__(self, docs: DataFrame, classes: DataFrame, links: DataFrame):
        self.docs, self.sketches = docs, classes.select("node", "one", "sketch")
        self.stars = components(links)
        self.tried: DataFrame | None = None

    def placed(self, members: DataFrame) -> DataFrame:
        """members with their components."""
        return members.join(self.stars, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def open(self, members: DataFrame, *by: str) -> DataFrame:
        """Placed members of those lists (or parts) that hold several components, written."""
        now = self.placed(members)
        several = now.groupBy(*by).agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select(*by)
        return written(now.join(several, list(by), "left_semi"))

    def round(self, now: DataFrame, nearest: int | None) -> tuple[bool, DataFrame]:
        """Propose among placed members, verify and merge; whether links were found, and the members with further partners."""
        n = now.count()
        dealt = now.join(self.sketches, ["node", "one"])
        if "side" not in now.columns:
            dealt = dealt.withColumn("side", F.lit(0))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("list", "part"), F.lit(max(16, n // CHUNK))))
        work = written(dealt.select("chunk", "list", "part", "side", "node", "one", "n", "component", "sketch").groupBy("chunk").applyInPandas(_propose(nearest), _WORK))
        further = work.filter("side = -2").select(F.col("unit").alias("list"), F.col("b").alias("part"), (F.col("b") != 0).alias("several"), F.col("a").alias("node"), F.col("a_name").alias("one"), F.col("b_name").alias("n"))
        further = written(further)
        pair = ["a", "a_name", "b", "b_name"]
        pairs = work.filter("side = -1").groupBy(*pair).agg(F.min("unit").alias("unit"), F.min("side").alias("side"))
        if self.tried is not None:
            pairs = pairs.join(self.tried, pair, "left_anti")
        todo = written(pairs.select("unit", *pair, "side").unionByName(work.filter("side >= 0")))
        discard(work)
        if todo.isEmpty():
            return False, further
        found = _verified(todo, self.docs)
        done = todo.filter("side < 0").select(*pair)
        self.tried = done if self.tried is None else self.tried.unionByName(done)
        if found.isEmpty():
            return False, further
        before, self.stars = self.stars, components(self.stars.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found))
        discard(before)
        discard(found)
        return True, further


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's size and names, and each distinct set with its smallest id and sketch."""
    described = written(docs.mapInArrow(_describe, "doc_id long, n long, one long, two long, sketch binary"))
    known = described.filter("doc_id IS NOT NULL AND n > 0")
    return described, written(known.groupBy("one", "two", "n").agg(F.min("doc_id").alias("node"), F.any_value("sketch").alias("sketch")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described, classes = _classes(docs)
    known = described.filter("doc_id IS NOT NULL AND n > 0")
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(0.6 * total / BUCKET) + 1)
    packed = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(_index(buckets), "bucket long, list long, names binary, counts binary, entries binary")
    lists = packed.groupBy("bucket").applyInPandas(_lists, "list long, part long, several boolean, names array<long>")
    raw = written(lists)
    # the buckets have dealt the lists of a group of near copies apart: they meet again by their first members
    short = raw.filter("NOT several").select(F.pmod(F.xxhash64(F.col("names")[0]), F.lit(max(16, raw.count() // CHUNK))).alias("chunk"), "names")
    met = short.groupBy("chunk").applyInPandas(_regather, "list long, part long, several boolean, names array<long>")
    every = met.unionByName(raw.filter("several"))
    members = written(_joined(every.groupBy("list", "part").agg(F.any_value("several").alias("several"), F.any_value("names").alias("names")), classes))
    discard(raw)
    search = Search(docs, classes, _shared_ids(known, classes))
    alone, parts = members.filter("NOT several"), members.filter("several")
    split = not parts.isEmpty()
    merging = alone
    if split:
        # of the parts that a set is in, one is enough to merge near copies
        first = parts.groupBy("node", "one", "n").agg(F.min(F.struct("list", "part")).alias("at")).select("at.list", "at.part", F.lit(True).alias("several"), "node", "one", "n")
        merging = written(alone.select(*first.columns).unionByName(first))
    for _ in range(2):
        now = search.open(merging, "list", "part")
        # a set whose every partner in a part has been proposed is done there: only the others go on
        _, further = search.round(now, NEAREST)
        discard(now, merging)
        merging = further
    while split:
        # one member of each component stands for it, so that parts of one group of near copies meet
        now = search.open(parts, "list")
        split = not now.isEmpty()
        stand = now.groupBy("list", "component").agg(F.min(F.struct("node", "one", "n")).alias("s")).select("list", "s.*", "component")
        counts = stand.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("p"))
        stand = written(stand.join(counts, "list").withColumn("part", F.pmod(F.xxhash64("component"), F.col("p"))).drop("p"))
        more = False
        if split:
            more, further = search.round(stand, NEAREST)
            discard(further)
        discard(now, stand)
        if not more:
            break
    now = search.open(merging.filter("NOT several"), "list").withColumn("side", F.lit(0)).select("list", "part", "side", "node", "one", "n", "component")
    if split:
        rest = search.open(parts, "list")
        every = rest.groupBy("list").agg(F.collect_set("part").alias("parts"))
        rest = rest.join(every, "list").withColumn("q", F.explode("parts"))
        rest = rest.withColumn("side", (F.col("part") > F.col("q")).cast("int")).withColumn("part", F.xxhash64(F.least("part", "q"), F.greatest("part", "q")))
        now = now.unionByName(rest.select(*now.columns))
    search.round(now, None)
    discard(members, merging)
    named = classes.select("one", "two", "n", "node").join(search.stars, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component_id"))
    rows = described.select("doc_id", F.col("n").alias("n_shingles"), "one", "two", "n")
    full = rows.filter("n > 0").join(named, ["one", "two", "n"], "left").select("doc_id", "n_shingles", "component_id")
    # an id with an empty row and others is one vertex
    bare = rows.filter("n = 0").select("doc_id", "n_shingles")
    own = full.filter("doc_id IS NOT NULL").join(bare.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.unionByName(bare.join(own, "doc_id", "left").select(*full.columns)).withColumn("component_id", component)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the row with the smallest id (of rows with that id, one); null ids stay."""
    found = written(jaccard_components(docs).filter("doc_id IS NULL OR doc_id = component_id").groupBy("doc_id").count())
    kept = docs.join(found.select("doc_id"), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    repeated = found.filter("doc_id IS NOT NULL AND count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    # only ids that do repeat are grouped
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
