"""Scores of a basket's zones and the ranking inside a basket (R3a-R3f), in Arrow batches.

A basket comes with its items and the list of its word set; it leaves with its few best
candidates, told by their places in the list.  A batch is ranked by two stable sorts of
plain numbers; the names, reasons and prices of the list stay in the row and are not
sent to the worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATES = 400_000        # about so many are ranked at once, whatever the batch
NONE = -2 ** 62             # stands for null
ZONES = "base array<bigint>, n_own array<int>, n_zone bigint"
TOP = "array<struct<at:int,item:int,word:int,confidence:double>>"


class ZoneTables:
    """The fixed rule tables by zone: ``categories``, sizes of the zones, the category codes
    with their scores and the scores of the word codes (None where there is none)."""

    def __init__(self, categories: list, sizes: list, gives: dict, pairs: list):
        self.categories, self.sizes, self.n = categories, np.array(sizes, dtype=np.int64), len(categories)
        self.sources = np.array(sorted(gives), dtype=np.int64)
        self.gives, self.pairs = self._table([gives[k] for k in sorted(gives)]), self._table(pairs)

    def _table(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores and whether there are any: a row a code and one for no code, a column a zone and one for no zone."""
        score = np.zeros((len(rows) + 1, self.n + 1), dtype=np.int64)
        there = np.zeros(score.shape, dtype=bool)
        for i, per in enumerate(rows):
            score[i, :self.n], there[i, :self.n] = [x or 0 for x in per], [x is not None for x in per]
        return score, there


def _tools():
    """Functions for list columns, made here so that they travel with the UDFs."""
    def flat(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the rows' lists and their values, one after another."""
        n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return n, pc.fill_null(a.flatten().cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)

    def place(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of values in a sorted array, len(of) for those that are not there."""
        at = np.searchsorted(of, x)
        return np.where(np.append(of, NONE)[at] == x, at, len(of))

    def reduced(how: np.ufunc, n: np.ndarray, rows: np.ndarray, empty) -> np.ndarray:
        """The rows of each list as one."""
        out = np.full((len(n), rows.shape[1]), empty, dtype=rows.dtype)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = how.reduceat(rows, (np.cumsum(n) - n)[some], axis=0)
        return out
    return flat, place, reduced


def zone_scores(tables: ZoneTables):
    """Column function (item categories, word codes, zones of own products): R3a, R3b, the sum
    of complements and pairings by zone (null without any), the basket's own products by
    zone, and how many products of the scored zones it has not."""
    flat, place, reduced = _tools()
    (give, gives), (pair, pairs) = tables.gives, tables.pairs
    sources, sizes, n_zones = tables.sources, tables.sizes, tables.n

    def sums(item_categories: pa.Array, word_codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n_items, category = flat(item_categories)
        n_words, word = flat(word_codes)
        code = place(sources, category)
        return (reduced(np.add, n_items, give[code], 0) + reduced(np.add, n_words, pair[word], 0),
                reduced(np.logical_or, n_items, gives[code], False) | reduced(np.logical_or, n_words, pairs[word], False))

    def run(item_categories: pa.Array, word_codes: pa.Array, own: pa.Array) -> pa.Array:
        score, there = (x[:, :n_zones] for x in sums(item_categories, word_codes))
        size, (n, zone) = len(score), flat(own)
        n_own = np.bincount(np.repeat(np.arange(size), n) * n_zones + zone, minlength=size * n_zones).reshape(size, n_zones)
        n_zone = np.where(there, sizes - n_own, 0).sum(axis=1, dtype=np.int64)
        ends = pa.array(np.arange(size + 1) * n_zones, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(score.ravel(), mask=~there.ravel())),
             pa.ListArray.from_arrays(ends, pa.array(n_own.ravel().astype(np.int32))), pa.array(n_zone)], ["base", "n_own", "n_zone"])

    def of(*columns: Column) -> Column:
        return F.arrow_udf(run, ZONES).asNondeterministic()(*columns)
    of.sums = sums
    return of


def best_of_basket(tables: ZoneTables, meals, categories, cap: int, limit: int, fill_score: int):
    """Column function: the first ``limit`` candidates of each basket by score, then
    product_id, with no more than ``cap`` of a category.

    Arguments of the result, all arrays (ids sorted): the basket's item ids, item categories
    and word codes, its list's ids, zones, scores and whether a rule reached them, and
    the ids and categories of its fill.

    ``at`` is a place in the list, or -1 - a place in the fill; ``item`` and ``word`` tell what
    scores the zone first, -1 if nothing does; W7: ``confidence`` is by the basket's best."""
    flat, placed, reduced = _tools()
    sums = zone_scores(tables).sums
    zone_category, n_zones = tables.categories, tables.n
    gives, pairs, sources = tables.gives[1], tables.pairs[1], tables.sources
    known = np.unique(np.array([c for c in [*zone_category, *categories] if c is not None], dtype=np.int64))
    code_of_zone = placed(known, np.array([NONE if c is None else c for c in zone_category], dtype=np.int64))
    is_meal = np.append(np.isin(known, list(meals)), False)

    def within(n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def first(n: np.ndarray, table: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Per row and zone the value of the first of its codes that scores the zone, else -1."""
        at = np.where(table, np.arange(len(table))[:, None], len(table))
        return np.append(value, -1)[reduced(np.minimum, n, at, len(table))]

    def chunk(item_ids, item_categories, word_codes, ids, zones, units, reached, fill_ids, fill_categories):
        size = len(item_ids)
        by_zone, scored = sums(item_categories, word_codes)         # the last column stands for no zone

        n_list, cid = flat(ids)
        row, at, zone, unit, hit = np.repeat(np.arange(size), n_list), within(n_list), flat(zones)[1], flat(units)[1], flat(reached)[1] == 1
        category = code_of_zone[zone]
        n_fill, fid = flat(fill_ids)
        if len(fid):
            fills = (np.repeat(np.arange(size), n_fill), -1 - within(n_fill), np.full(len(fid), -1), np.full(len(fid), fill_score),
                     np.full(len(fid), True), placed(known, flat(fill_categories)[1]), fid)
            both = [np.concatenate(x) for x in zip(fills, (row, at, zone, unit, hit, category, cid))]
            order = np.lexsort((both[-1], both[0]))
            row, at, zone, unit, hit, category, cid = (x[order] for x in both)

        # what the basket's own items leave
        n_items, own = flat(item_ids)
        own_row = np.repeat(np.arange(size), n_items)
        distinct, own_at = np.unique(own, return_inverse=True)
        place = placed(distinct, cid)
        same_id = np.flatnonzero(place < len(distinct))
        left = hit | scored[row, zone]
        left[same_id] &= ~np.isin(row[same_id] * len(distinct) + place[same_id], own_row * len(distinct) + own_at)
        row, at, zone, unit, category = (x[left] for x in (row, at, zone, unit, category))

        # R3e: meal penalty, in per cent, rounded half up
        own_category = flat(item_categories)[1]
        same = np.zeros((size, len(known) + 1), dtype=bool)
        same[own_row, placed(known, own_category)] = True
        has_meal = np.zeros(size, dtype=bool)
        has_meal[own_row[np.isin(own_category, list(meals))]] = True
        meal = is_meal[category]
        percent = np.where(meal & same[row, category], 10, np.where(meal & has_meal[row], 25, 100))
        score = ((by_zone[row, zone] + unit) * percent + 50) // 100

        # R3f: cap per category, then the best of the row
        def best(group: np.ndarray, some: np.ndarray, most: int) -> np.ndarray:
            order = some[np.lexsort((-score[some], group[some]))]
            g = group[order]
            begins = np.flatnonzero(np.append(True, g[1:] != g[:-1])[:len(g)])
            rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
            return order[rank < most]

        capped = best(row * (len(known) + 1) + category, np.arange(len(row)), cap)
        top = best(row, np.sort(capped), limit)
        row, at, zone, score = (x[top] for x in (row, at, zone, score))

        n_words, word_code = flat(word_codes)
        item = first(n_items, gives[placed(sources, own_category)], within(n_items))[row, zone]
        word = first(n_words, pairs[word_code], word_code)[row, zone]
        n = np.bincount(row, minlength=size)
        ends = np.append(0, np.cumsum(n))
        most = np.repeat(score[ends[:-1][n > 0]], n[n > 0])
        confidence = np.minimum(0.95, np.maximum(0.50, score / 1e10 / np.maximum(most / 1e10, 0.01) * 0.95))
        fields = {"at": at.astype(np.int32), "item": item.astype(np.int32), "word": word.astype(np.int32), "confidence": np.rint(confidence * 100) / 100}
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], [*fields]))

    def run(item_ids: pa.Array, item_categories: pa.Array, word_codes: pa.Array, ids: pa.Array, zones: pa.Array,
            units: pa.Array, reached: pa.Array, fill_ids: pa.Array, fill_categories: pa.Array) -> pa.Array:
        columns = (item_ids, item_categories, word_codes, ids, zones, units, reached, fill_ids, fill_categories)
        work = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (item_ids, ids, fill_ids))
        step = np.cumsum(work) // CANDIDATES
        begins = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(ids)]
        parts = [chunk(*(c.slice(a, b - a) for c in columns)) for a, b in zip(begins, begins[1:], strict=False)]
        return pa.concat_arrays(parts)

    def of(*columns: Column) -> Column:
        return F.arrow_udf(run, TOP).asNondeterministic()(*columns)
    return of
