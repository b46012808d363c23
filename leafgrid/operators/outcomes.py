"""Outcomes of blocks, many whole pages at a time: the matching of ``matching`` in NumPy over Arrow batches.

Spark brings a document's rows together and orders them by page; a batch ends between pages, and the pairs of a page are formed in tiles, so a worker
holds one batch, or one page if that is larger, and at most ``TILE`` pairs besides those that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GT, PRED, DOCUMENT, CHARTS = 1, 2, 3, 4
#: Most pairs that are formed before those without overlap are left out.
TILE = 1 << 21


@dataclass(frozen=True)
class Rules:
    min_iou: float
    min_coverage: float | None
    region_coverage: float | None
    exempt: tuple[str, ...]
    loose: tuple[str, ...]
    chart_labels: tuple[str, ...]
    chart_coverage: float


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, cut between pages only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = _starts(batch["doc"], batch["page_id"])
        cut = int(new[-1])
        if held and _same(held[-1], batch) and cut == 0:
            held.append(batch)
            continue
        if held and not _same(held[-1], batch):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a[c][a.num_rows - 1] == b[c][0] for c in ("doc", "page_id"))


def _codes(column) -> np.ndarray:
    """A number per value, -1 for null."""
    encoded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(doc, page) -> np.ndarray:
    d, p = _codes(doc), _codes(page)
    return np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])]))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def _crossed(left: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of pairs of each left row with the ``count`` rows from ``start``."""
    ends = np.cumsum(count)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
        n = count[at:to]
        first = np.repeat(start[at:to] - (np.cumsum(n) - n), n)
        yield np.repeat(left[at:to], n), first + np.arange(len(first))
        at = to


def _intersection(box: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = np.minimum(box[2][a], box[2][b]) - np.maximum(box[0][a], box[0][b])
    high = np.minimum(box[3][a], box[3][b]) - np.maximum(box[1][a], box[1][b])
    return np.maximum(wide, 0) * np.maximum(high, 0)


def _greedy(g: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Of pairs in order of preference, those that a greedy choice keeps: in rounds, each pair that is the first left of both its rows."""
    left, kept = np.arange(len(g)), []
    while len(left):
        first = np.full(n, len(g))
        for rows in (g, p):  # ground truth and predictions are different rows of one table
            first[rows[left[::-1]]] = left[::-1]
        take = left[(first[g[left]] == left) & (first[p[left]] == left)]
        kept.append(take)
        gone = np.zeros(n, bool)
        gone[g[take]] = gone[p[take]] = True
        left = left[~(gone[g[left]] | gone[p[left]])]
    return np.concatenate(kept) if kept else left


def _components(g: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[g], root[p])
        new = root.copy()
        for rows in (g, p, root[g], root[p]):
            np.minimum.at(new, rows, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _union(boxes: list[tuple[float, float, float, float]]) -> float:
    xs, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for left, right in zip(xs[:-1], xs[1:]):
        end, height = -np.inf, 0.0
        for top, bottom in sorted((b[1], b[3]) for b in boxes if b[0] < right and b[2] > left):
            height += max(0.0, bottom - max(top, end))
            end = max(end, bottom)
        total += (right - left) * height
    return total


class Pages:
    """Whole pages in order of page and side."""

    def __init__(self, t: pa.Table, rules: Rules) -> None:
        self.t, self.rules, self.n = t, rules, t.num_rows
        side = t["side"].to_numpy()
        page = np.zeros(self.n, np.int64)
        page[_starts(t["doc"], t["page_id"])] = 1
        unkeyed = np.asarray(t["doc"].is_null()) | np.asarray(t["page_id"].is_null())  # rows without a page are not compared
        page[unkeyed] = 1
        page[1:][unkeyed[:-1]] = 1
        self.side, self.page = side, np.cumsum(page) - 1
        self.box = np.stack([pc.cast(t[c], pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")])
        self.area = np.maximum(self.box[2] - self.box[0], 0) * np.maximum(self.box[3] - self.box[1], 0)
        self.label, self.level = _codes(t["label"]), _codes(t["level"])
        self.order = np.asarray(pc.fill_null(pc.cast(t["idx"], pa.int64()), -1))
        is_in = lambda names: np.asarray(pc.is_in(t["label"], pa.array(names, pa.string()))) if names else np.zeros(self.n, bool)
        self.loose, self.exempt, self.answers, self.chart = (is_in(names) for names in (rules.loose, rules.exempt, rules.chart_labels, ("flowchart",)))
        listed = np.zeros(self.page[-1] + 1, bool)
        listed[self.page[side == CHARTS]] = True
        self.chart &= listed[self.page] & (side == GT)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pages = self.page[-1] + 1
        pred = np.flatnonzero(self.side == PRED)
        count = np.bincount(self.page[pred], minlength=pages)
        start = np.cumsum(count) - count
        gt = np.flatnonzero(self.side == GT)
        parts = []
        for g, at in _crossed(gt, start[self.page[gt]], count[self.page[gt]]):
            p = pred[at]
            common = _intersection(self.box, g, p)
            keep = common > 0
            if self.rules.min_iou == 0:
                keep |= common == 0
            parts.append((g[keep], p[keep], common[keep]))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (pred[:0], pred[:0], np.zeros(0))

    def _by_label(self) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.flatnonzero((self.side == s) & self.loose) for s in (GT, PRED)]
        place = []
        for r in rows:
            box = [np.where(np.isnan(c[r]), -np.inf, c[r]) for c in self.box]
            order = np.lexsort((self.order[r], box[3], box[2], box[1], box[0], self.label[r], self.page[r]))
            r[:] = r[order]
            new = np.concatenate([[True], (self.page[r][1:] != self.page[r][:-1]) | (self.label[r][1:] != self.label[r][:-1])])[: len(r)]
            place.append(np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)))
        labels, most = self.label.max(initial=0) + 1, max((k.max(initial=0) for k in place), default=0) + 1
        _, a, b = np.intersect1d(*((self.page[r] * labels + self.label[r]) * most + k for r, k in zip(rows, place)), assume_unique=True, return_indices=True)
        return rows[0][a], rows[1][b]

    def _charts(self, g: np.ndarray, p: np.ndarray, common: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
        """The best answer of each flowchart that counts, and which predictions are accepted: in order of position, each takes all free ones that overlap it."""
        keep = self.chart[g] & self.answers[p] & (common > 0)
        g, p, common = g[keep], p[keep], common[keep]
        covered, iou = _ratio(common, self.area[g]), _ratio(common, self.area[g] + self.area[p] - common)
        order = np.lexsort((self.order[g], self.page[g]))
        found: dict[int, list] = {}
        for row, *one in zip(g[order].tolist(), covered[order].tolist(), iou[order].tolist(), self.order[p[order]].tolist(), p[order].tolist()):
            found.setdefault(row, []).append(one)
        best, accepted = {}, np.zeros(self.n, bool)
        for row, all_ in found.items():
            free = [x for x in all_ if not accepted[x[3]]]
            if free and max(free)[0] >= self.rules.chart_coverage:
                best[row] = max(free)[3]
                accepted[[x[3] for x in free]] = True
        return best, accepted

    def _regions(self, g: np.ndarray, p: np.ndarray, common: np.ndarray, texts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows of regions with the same content; see ``matching.equivalent_regions``."""
        share, good = self.rules.region_coverage, np.zeros(self.n, bool)
        if not len(g):
            return good
        root = _components(g, p, self.n)
        linked = np.zeros(self.n, bool)
        linked[g] = linked[p] = True
        sizes, lengths, counts = [], [], []
        for s in (GT, PRED):
            rows = np.flatnonzero(linked & (self.side == s))
            sizes.append(np.bincount(root[rows], minlength=self.n))
            owner, char = texts
            mine = linked[owner] & (self.side[owner] == s)
            lengths.append(np.bincount(root[owner[mine]], minlength=self.n))
            counts.append(np.unique(root[owner[mine]] * 0x110000 + char[mine], return_counts=True))
        _, a, b = np.intersect1d(counts[0][0], counts[1][0], assume_unique=True, return_indices=True)
        shared = np.bincount(counts[0][0][a] // 0x110000, np.minimum(counts[0][1][a], counts[1][1][b]), self.n)
        of = [_ratio(shared, n.astype(float)) for n in lengths]
        heads = np.unique(root[linked])
        single = (sizes[0] == 1) & (sizes[1] == 1)
        by_text = ((of[0] >= share) & (of[1] >= share)) | (single & (of[0] >= 0.9))
        right = np.zeros(self.n, bool)
        right[heads] = by_text[heads]
        left = np.zeros(self.n, bool)
        left[heads] = ~by_text[heads] & ~single[heads]
        if left.any():
            left &= ~self._crowded(np.flatnonzero(linked & left[root]), root)
        keep = left[root[g]]
        if keep.any():
            bad = np.zeros(self.n, bool)
            for own, other in ((g[keep], p[keep]), (p[keep], g[keep])):
                order = np.argsort(own, kind="stable")
                bad[root[self._uncovered(own[order], other[order], common[keep][order], share)]] = True
            right |= left & ~bad
        good[linked] = right[root[linked]]
        return good

    def _crowded(self, rows: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Components in which two boxes of one side share over half of the smaller one."""
        out = np.zeros(self.n, bool)
        rows = rows[np.lexsort((self.side[rows], root[rows]))]
        new = np.concatenate([[True], (root[rows][1:] != root[rows][:-1]) | (self.side[rows][1:] != self.side[rows][:-1])])
        group = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(rows))[group]
        here = np.arange(len(rows))
        for a, b in _crossed(here, here + 1, ends - here - 1):
            a, b = rows[a], rows[b]
            over = _ratio(_intersection(self.box, a, b), np.minimum(self.area[a], self.area[b])) > 0.5
            out[root[a[over]]] = True
        return out

    def _uncovered(self, own: np.ndarray, other: np.ndarray, common: np.ndarray, share: float) -> np.ndarray:
        """Rows of ``own`` (sorted) whose partners together cover less than a share of them."""
        rows, first, count = np.unique(own, return_index=True, return_counts=True)
        covered = np.add.reduceat(common, first)
        clipped = np.stack([np.maximum(self.box[0][own], self.box[0][other]), np.maximum(self.box[1][own], self.box[1][other]), np.minimum(self.box[2][own], self.box[2][other]), np.minimum(self.box[3][own], self.box[3][other])])
        two = np.flatnonzero(count == 2)
        covered[two] -= _intersection(clipped, first[two], first[two] + 1)
        for i in np.flatnonzero((count > 2) & (_ratio(covered, self.area[rows]) >= share)):  # the sum is an upper bound
            covered[i] = _union([tuple(b) for b in clipped[:, first[i] : first[i] + count[i]].T.tolist()])
        return rows[_ratio(covered, self.area[rows]) < share]

    def _characters(self) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(self.t["text"], "").to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.repeat(np.arange(self.n), lengths), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)

    def outcomes(self, schema: pa.Schema) -> pa.RecordBatch:
        r, n = self.rules, self.n
        g, p, common = self._pairs()
        solid = ~self.loose & (self.label >= 0)
        iou, covered = _ratio(common, self.area[g] + self.area[p] - common), _ratio(common, self.area[g])
        keep = solid[g] & solid[p] & (iou >= r.min_iou)
        if r.min_coverage is not None:
            keep &= covered >= r.min_coverage
        at = np.flatnonzero(keep)
        at = at[np.lexsort((-self.order[p[at]], -self.order[g[at]], -covered[at], -iou[at]))]
        at = at[_greedy(g[at], p[at], n)]
        own, said = self._by_label() if r.loose else (g[:0], p[:0])
        match = np.full(n, -1)
        match[g[at]], match[own] = p[at], said
        used = np.zeros(n, bool)
        used[match[match >= 0]] = True
        best, accepted = self._charts(g, p, common) if self.chart.any() else ({}, np.zeros(n, bool))
        if best:
            match[list(best)] = list(best.values())
        used |= accepted
        rows = np.flatnonzero(match >= 0)
        other = match[rows]
        same, same_level = np.zeros(n, bool), np.zeros(n, bool)
        equal = (self.label[rows] >= 0) & (self.label[rows] == self.label[other])
        level = equal & (self.level[rows] >= 0) & (self.level[rows] == self.level[other])
        for flags, found in ((same, equal), (same_level, level)):
            flags[rows] = found
            flags[other[found]] = True
        strict = same & (self.side == GT)
        chart = accepted
        chart[list(best)] = True
        if r.region_coverage is not None:
            keep = solid[g] & solid[p] & (common > 0) & (self.label[g] == self.label[p])
            g, p, common = g[keep], p[keep], common[keep]
            texts = self._characters()
            same = same | self._regions(g, p, common, texts)
            keep = (self.level[g] >= 0) & (self.level[g] == self.level[p])
            same_level = same_level | self._regions(g[keep], p[keep], common[keep], texts)
        truth = (self.side == GT) | np.asarray(pc.fill_null(self.t["known"], False))
        blocks = np.flatnonzero((self.side == GT) | (self.side == PRED))
        partner = pa.array(np.maximum(match, 0)[blocks], mask=(match < 0)[blocks])
        made = {
            "pred_idx": self.t["idx"].take(partner), "pred_label": self.t["label"].take(partner), "pred_level": self.t["level"].take(partner),
            "used": (used | (match >= 0))[blocks], "strict": strict[blocks], "correct": (truth & (same | self.exempt | chart))[blocks],
            "correct_level": (truth & (same_level | self.exempt | chart))[blocks],
        }
        kept = self.t.take(pa.array(blocks))
        columns = [made[f.name] if f.name in made else kept[f.name] for f in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
