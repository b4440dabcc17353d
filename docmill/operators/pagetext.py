"""The steps of layout.py from words to texts of pages, over arrays of many whole documents at once.

Words of a document that lie together meet here without being dealt out; what layout.py says of lines, columns, tables and
headings holds, and tests compare the two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many words are laid out at once, more only where one document has more.
WORDS = 1 << 18
WIDTH = 612.0


def _ends(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


def _number(ends: np.ndarray) -> np.ndarray:
    """Number of its run for every element."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _order(*keys: np.ndarray) -> np.ndarray:
    """A stable order by keys, the first one first; none is made for what is in order."""
    later = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in reversed(keys):
        later = (k[1:] < k[:-1]) | ((k[1:] == k[:-1]) & later)
    return np.lexsort(keys[::-1]) if later.any() else np.arange(len(keys[0]))


def _joined(texts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), by)


def _bands(of: np.ndarray, size: float) -> np.ndarray:
    return np.rint(of / size)


def upper_medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The upper median of each of n groups, NaN for empty ones; NaNs do not count."""
    some = ~np.isnan(values)
    values, group = values[some], group[some]
    at = np.lexsort((values, group))
    counts = np.bincount(group, minlength=n)
    out = np.full(n, np.nan)
    has = counts > 0
    out[has] = values[at][(np.cumsum(counts) - counts + counts // 2)[has]]
    return out


def cluster_starts(values: np.ndarray, ends: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Which values of each sorted run start a cluster: the first, and each that is more than the run's gap after the last start."""
    n = np.diff(ends)
    runs = np.argsort(-n, kind="stable")
    n, first, gap = n[runs], ends[:-1][runs], gap[runs]
    out = np.zeros(len(values), bool)
    last = np.full(len(runs), -np.inf)
    still = len(runs)
    for k in range(int(n[0]) if len(n) else 0):
        while still and n[still - 1] <= k:
            still = int(np.searchsorted(-n, -k, "left"))
        at = first[:still] + k
        x = values[at]
        new = x - last[:still] > gap[:still]
        last[:still] = np.where(new, x, last[:still])
        out[at] = new
    return out


class _Words:
    """Columns of words; at() takes some of them, in an order."""

    def __init__(self, **columns):
        self.__dict__ |= columns

    def at(self, i: np.ndarray) -> _Words:
        return _Words(**{k: v[i] for k, v in self.__dict__.items()})


def _kinds(w: _Words, n: int) -> np.ndarray:
    """Dividers of pages of two columns, NaN for other pages; the words are those of n pages."""
    line = np.trunc(w.top / 4)
    at = _order(w.p, line)
    p, x0 = w.p[at], w.x0[at]
    left = x0 < w.width[at] / 2
    ends = _ends(p * (1 << 32) + line[at].astype(np.int64))
    first = ends[:-1]
    x, of, width = np.minimum.reduceat(x0, first), p[first], np.maximum.reduceat(w.width[at], first)
    has_left, has_right = np.logical_or.reduceat(left, first), np.logical_or.reduceat(~left, first)
    count = lambda p: np.bincount(p, minlength=n)
    lines, words = count(of), count(p)
    middle = (x > width * 0.35) & (x < width * 0.60)
    divider = upper_medians(x[middle], of[middle], n)
    straddlers = count(w.p[np.abs((w.x0 + w.x1) / 2 - divider[w.p]) < 10])
    least = np.maximum(lines, 1)
    right, left = count(of[has_right & ~has_left]) / least, count(of[has_left & ~has_right]) / least
    single = (words < 30) | (lines < 8) | (count(of[middle]) < lines * 0.15)
    two = ~single & ~((right >= 0.15) & (left < 0.05)) & (left >= 0.10) & (right >= 0.10) & (straddlers / np.maximum(words, 1) < 0.05)
    return np.where(two, divider, np.nan)


def _prose(w: _Words, words: pa.Array, strip: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Pages and their texts: lines of words, marked as headings by their letters against the body's of their page."""
    band = (_bands(w.top, 3) * 3).astype(np.int64)
    at = _order(w.p, strip, band, w.x0, w.seq)
    w, strip, band = w.at(at), strip[at], band[at]
    ends = _ends((w.p * 2 + strip) * (1 << 32) + band)
    of = w.p[ends[:-1]]
    text = _joined(words.take(pa.array(w.i)), ends, " ")
    mean = np.bincount(_number(ends), weights=w.size, minlength=len(of)) / np.diff(ends)
    base = body[of]
    ratio = np.divide(mean, base, out=np.ones(len(of)), where=base > 0)
    n = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    large = np.flatnonzero((ratio >= 1.25) & (n >= 4) & (n <= 150))
    mark = np.zeros(len(of), np.int64)
    if len(large):
        some = text.take(pa.array(large))
        other = pc.or_(pc.match_substring(some, "|"), pc.match_substring_regex(some, r"^[. ]*[0-9][0-9. ]*$")).to_numpy(zero_copy_only=False)
        mark[large] = np.where(other, 0, np.where(ratio[large] >= 1.5, 2, 1))
        text = pc.binary_join_element_wise(pa.array(["", "## ", "# "]).take(pa.array(mark)), text, "")
    pages = _ends(of)
    return of[pages[:-1]], _joined(text, pages, "\n")


def _columns(xs: np.ndarray, p: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Columns of n pages, a row for each, filled up with NaN, from sorted places; NaN alone for pages without columns."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(p, minlength=n))))
    step, of = np.diff(xs), p[1:]
    gap = (p[1:] == p[:-1]) & (step > 5)
    step, of = step[gap], of[gap]
    step = step[np.lexsort((step, of))]
    counts = np.bincount(of, minlength=n)
    gaps = np.full(n, 35.0)
    many = counts >= 3
    gaps[many] = np.clip(step[(np.cumsum(counts) - counts + (counts * 0.70).astype(np.int64))[many]], 25.0, 50.0)
    start = cluster_starts(xs, ends, gaps)
    c, of = xs[start], p[start]
    k = np.bincount(of, minlength=n)
    first = np.cumsum(k) - k
    place = np.arange(len(c)) - first[of]
    several = k > 1
    span = np.ones(n)
    span[several] = c[(first + k - 1)[several]] - c[first[several]]
    good = several & (span / np.maximum(k, 1) >= 30) & (k / (span / 72) <= 10) & (k <= np.maximum(15, np.floor(20 * width / WIDTH)))
    out = np.full((n, int(k[good].max()) if good.any() else 1), np.nan)
    here = good[of]
    out[of[here], place[here]] = c[here]
    return out


def _forms(w: _Words, words: pa.Array, n: int, least: int = 3) -> tuple[np.ndarray, pa.Array]:
    """Pages that are forms and their texts, with the table regions as pipe tables."""
    band = _bands(w.top, 5)
    at = _order(w.p, band, w.x0, w.seq)
    w, band = w.at(at), band[at]
    ends = _ends(w.p * (1 << 32) + band.astype(np.int64))
    first, line = ends[:-1], _number(ends)
    of, size = w.p[first], np.diff(ends)
    width = np.maximum.reduceat(w.width, first)
    length = np.add.reduceat(w.chars, first) + size - 1
    paragraph = (w.x1[ends[1:] - 1] - w.x0[first] > width * 0.55) & (length > 60)
    start = cluster_starts(w.x0, ends, np.full(len(of), 50.0))
    mine = ~paragraph & (size >= 3) & (np.add.reduceat(start.astype(np.int64), first) >= 3)
    xs = start & mine[line]
    page_width = np.zeros(n)
    np.maximum.at(page_width, of, width)
    at = np.lexsort((w.x0[xs], w.p[xs]))
    columns = _columns(w.x0[xs][at], w.p[xs][at], page_width, n)
    # Lines of pages with columns, and which of them are table rows.
    some = ~np.isnan(columns[:, 0])
    if not some.any():
        return np.zeros(0, np.int64), pa.array([], pa.string())
    near = np.full(len(w.p), -1)
    mine = np.flatnonzero(some[w.p])
    x, p = w.x0[mine], w.p[mine]
    found = np.full(len(mine), -1)
    for k in range(columns.shape[1]):
        found[(found < 0) & (np.abs(x - columns[p, k]) < 40)] = k
    near[mine] = found
    lowest = np.minimum.reduceat(np.where(near < 0, columns.shape[1], near), first)
    several = lowest < np.maximum.reduceat(near, first)
    row = ~paragraph & several & some[of]
    maybe = np.flatnonzero(row)
    heads = pc.utf8_trim(words.take(pa.array(w.i[first[maybe]])), " ")
    row[maybe[pc.match_substring_regex(heads, r"^\.[0-9]+$").to_numpy(zero_copy_only=False)]] = False
    # Regions: rows without another line between them. The rule under the head cuts the head off from the rows below it.
    opens = row & ~np.concatenate(([False], row[:-1] & (of[1:] == of[:-1])))
    region = np.cumsum(opens) - 1
    n_rows = np.bincount(region[row], minlength=int(opens.sum()))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of[opens], np.where(n_rows > 1, n_rows - 1, n_rows))
    lines = np.bincount(of, minlength=n)
    form = some & (np.bincount(of[row], minlength=n) / np.maximum(lines, 1) >= 0.2) & (longest >= least)
    if not form.any():
        return np.zeros(0, np.int64), pa.array([], pa.string())
    shown, row, opens = form[of], row & form[of], opens & form[of]
    # Cells: a column ends where the next one starts, less some slack.
    rows = np.flatnonzero(row)
    k = (~np.isnan(columns)).sum(1)
    cells = np.concatenate(([0], np.cumsum(k[of[rows]])))
    base = np.zeros(len(of), np.int64)
    base[rows] = cells[:-1]
    inside = np.flatnonzero(row[line])
    x, p = w.x0[inside], w.p[inside]
    column = k[p] - 1
    for j in range(columns.shape[1] - 1, 0, -1):
        column[x < columns[p, j] - 20] = j - 1
    counts = np.bincount(base[line[inside]] + column, minlength=cells[-1])
    text = _joined(words.take(pa.array(w.i[inside])), np.concatenate(([0], np.cumsum(counts))), " ")
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    regions = np.flatnonzero(opens)
    region = np.cumsum(opens) - 1
    slots = np.concatenate(([0], np.cumsum(k[of[regions]])))
    slot = slots[region[np.repeat(rows, k[of[rows]])]] + np.arange(cells[-1]) - np.repeat(cells[:-1], k[of[rows]])
    widths = np.full(slots[-1], 3)
    np.maximum.at(widths, slot, chars)
    text = pc.binary_join_element_wise(text, pc.binary_repeat(" ", pa.array(widths[slot] - chars)), "")
    boxed = lambda t, ends: pc.binary_join_element_wise("| ", _joined(t, ends, " | "), " |", "")
    rules = boxed(pc.binary_repeat("-", pa.array(widths)), slots)
    others = np.flatnonzero(shown & ~row)
    inside = np.flatnonzero((shown & ~row)[line])
    plain = _joined(words.take(pa.array(w.i[inside])), np.concatenate(([0], np.cumsum(size[others]))), " ")
    # Rows, other lines and rules, by line.
    at = np.concatenate((rows * 2, others * 2, regions * 2 + 1))
    order = np.argsort(at, kind="stable")
    text = pa.concat_arrays([boxed(text, cells), plain, rules]).take(pa.array(order))
    of = of[at[order] // 2]
    pages = _ends(of)
    return of[pages[:-1]], _joined(text, pages, "\n")


def _texts(w: _Words, words: pa.Array, body: np.ndarray, n: int) -> pa.Array:
    """Texts of n pages from their words."""
    found = np.full(n, -1)
    parts = []

    def put(pages: np.ndarray, texts: pa.Array) -> None:
        found[pages] = sum(map(len, parts)) + np.arange(len(pages))
        parts.append(texts)

    if len(w.p):
        divider = _kinds(w, n)
        two = ~np.isnan(divider)
        rest = np.flatnonzero(~two[w.p])
        if len(rest):
            put(*_forms(w.at(rest), words, n))
        w = w.at(np.flatnonzero(found[w.p] < 0))
        if len(w.p):
            put(*_prose(w, words, (two[w.p] & ((w.x0 + w.x1) / 2 >= divider[w.p])).astype(np.int64), body))
    parts.append(pa.array([""]))
    found[found < 0] = sum(map(len, parts)) - 1
    return pa.concat_arrays(parts).take(pa.array(found))


def laid_out(t: pa.Table, crop: tuple[float, float] | None) -> pa.RecordBatch:
    """A row per document: doc_id and its pages (page, text) in order, from the words of whole documents."""
    t = t.combine_chunks()
    column = lambda c: t.column(c).chunk(0)
    number = lambda c: pc.cast(column(c), pa.float64()).to_numpy(zero_copy_only=False)
    runs = pc.run_end_encode(column("doc_id"))
    d = np.repeat(np.arange(len(runs.values)), np.diff(np.concatenate(([0], runs.run_ends.to_numpy()))))
    page, words = column("page").to_numpy(zero_copy_only=False).astype(np.int64), column("text")
    key = d * (1 << 32) + page
    if (key[1:] < key[:-1]).any():
        keys, p = np.unique(key, return_inverse=True)
    else:
        ends = _ends(key)
        keys, p = key[ends[:-1]], _number(ends)
    doc = keys >> 32
    width = number("width")
    w = _Words(i=np.arange(len(p)), p=p, seq=column("seq").to_numpy(zero_copy_only=False), x0=number("x0"), x1=number("x1"), top=number("top"), size=number("size"), width=np.where(np.isnan(width), WIDTH, width), chars=pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    early = page <= 20
    body = upper_medians(w.size[early], d[early], len(runs.values))
    if crop:
        right, top = crop
        w = w.at(np.flatnonzero((w.width <= right) | ((w.x1 <= w.width - right) & ((page > 1) | (w.top >= top)))))
    texts = _texts(w, words, np.where(np.isnan(body), 10.0, body)[doc], len(keys))
    pages = pa.StructArray.from_arrays([pa.array(keys & ((1 << 32) - 1), pa.int32()), texts], ["page", "text"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(runs.values)))))
    return pa.RecordBatch.from_arrays([runs.values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pages)], ["doc_id", "pages"])


def of_documents(batches: Iterator[pa.RecordBatch], crop: tuple[float, float] | None) -> Iterator[pa.RecordBatch]:
    """Documents from batches of words in which those of a document follow each other."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < WORDS:
            continue
        # The last document may go on in the next batch.
        last = len(b) - len(_last_run(b.column("doc_id")))
        if last == 0 and _same(held[:-1], b):
            continue
        done = [*held[:-1], b.slice(0, last)]
        held, n = [b.slice(last)], len(b) - last
        yield laid_out(pa.Table.from_batches(done), crop)
    if held:
        yield laid_out(pa.Table.from_batches(held), crop)


def _last_run(ids: pa.Array) -> pa.Array:
    ends = pc.run_end_encode(ids).run_ends
    return ids.slice(ends[-2].as_py() if len(ends) > 1 else 0)


def _same(before: list[pa.RecordBatch], b: pa.RecordBatch) -> bool:
    """Whether b goes on with the document that those before it end with, or nothing is before it."""
    return not before or before[-1].column("doc_id")[-1].as_py() == b.column("doc_id")[0].as_py()
