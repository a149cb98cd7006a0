"""Short texts against long ones, for Arrow tasks: where they stand whole, and their best-window similarity.

The measure is twice the longest common subsequence over the summed lengths, taken over every
window of the long text that has the length of the short one, and over the shorter windows that
touch either end of it. Many pairs of a text and a window are compared at once: a bit per character of
the text, in words of 64, and one step of whole-array operations per character of the windows.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# The similarity, in percent, from which a quote counts as found, and the longest
# quote that is compared this way.
FUZZY_THRESHOLD = 90
MAX_FUZZY_CHARS = 3000


#: What fills texts and windows up to a common length: no characters, and unlike each other.
_TEXT_PAD, _WINDOW_PAD = 0xFFFFFFFF, 0xFFFFFFFE
_CHECK_EVERY = 32
#: Characters of texts compared at once, windows tried at once of one text, and what a call prepares.
_BLOCK_CHARS, _WAVE, _CALL_QUOTES, _CALL_CHARS = 1 << 19, 32, 4096, 1 << 22
#: Windows first tried for a quote, and places of beginnings looked at at once.
_LIKELY, _BLOCK_PLACES = 4, 1 << 20
#: Multipliers by which the codes of two neighbouring runs become the code of both.
_BASES = [np.uint64(0x9E3779B97F4A7C13 + 0x632BE59BD9B4E01C * k & 0xFFFFFFFFFFFFFFFF | 3) for k in range(32)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` characters. They serve as a filter, so that a collision
    only costs a comparison."""
    codes = np.zeros(max(len(points) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - size + 1 + i]
    return codes


def _doubled(points: np.ndarray, level: int) -> np.ndarray:
    """Hashes of all runs of 2 ** level characters, from those of half the length."""
    codes = points * _BASES[-1]
    for k in range(level):
        codes = codes[: max(len(codes) - (1 << k), 0)] * _BASES[k] + codes[1 << k :]
    return codes


def _places(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``wanted`` codes (sorted) stand: the places code by code, and where each code's begin."""
    marked = np.zeros(1 << 18, dtype=bool)
    marked[(wanted >> np.uint64(46)).view(np.int64)] = True
    at = np.flatnonzero(marked[(codes >> np.uint64(46)).view(np.int64)])
    which = np.searchsorted(wanted, codes[at])
    known = wanted[np.minimum(which, len(wanted) - 1)] == codes[at]
    at, which = at[known], which[known]
    begins = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(wanted)))))
    return at[np.argsort(which, kind="stable")], begins


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of things by owner: the owner of each thing, and its number among its owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns of 64-bit words added as long numbers, the lowest word first; the last carry is lost."""
    total = a + b
    carry = (total < b)[:-1]
    while carry.any():
        total[1:] += carry
        carry = np.concatenate((np.zeros_like(carry[:1]), carry[:-1] & (total[1:-1] == 0)))
    return total


def _filled(rows: list[np.ndarray], width: int, pad: int) -> np.ndarray:
    table = np.full((len(rows), width), pad, dtype=np.uint32)
    table[np.arange(width) < np.array([len(r) for r in rows])[:, None]] = np.concatenate(rows)
    return table


def _reach(texts: list[np.ndarray], windows: list[np.ndarray], firsts: np.ndarray, threshold: float) -> np.ndarray:
    """For each pair whether some beginning of the window, of ``firsts`` characters or more, is similar
    enough to the text. Pairs that can no longer be are dropped on the way."""
    sizes, lasts = np.array([len(t) for t in texts]), np.array([len(w) for w in windows])
    width = -(-int(sizes.max()) // 64)
    left, right = _filled(texts, 64 * width, _TEXT_PAD), _filled(windows, int(lasts.max()), _WINDOW_PAD)
    # a bit is cleared for each character of the longest common subsequence
    state = np.full((width, len(texts)), ~np.uint64(0))
    rows, found = np.arange(len(texts)), np.zeros(len(texts), dtype=bool)
    soonest = firsts.min()
    for n in range(1, right.shape[1] + 1):
        match = np.packbits(left == right[:, n - 1, None], axis=1, bitorder="little").view(np.uint64).T & state
        state = _sums(state, match) | (state ^ match)
        if n < soonest and n % _CHECK_EVERY:
            continue
        shared = 64 * width - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
        similar = (n >= firsts) & (n <= lasts) & (200.0 * shared >= threshold * (sizes + n))
        found[rows[similar]] = True
        if n % _CHECK_EVERY == 0:
            kept = ~similar & (n < lasts) & (200.0 * (shared + lasts - n) >= threshold * (sizes + lasts)) & ~found[rows]
            rows, left, right, sizes, firsts, lasts = (x[kept] for x in (rows, left, right, sizes, firsts, lasts))
            state = state[:, kept]
            if not len(rows):
                break
            soonest = firsts.min()
    return found


class _Trials:
    """Pairs of a text and a window to be compared, each for the question it may settle."""

    def __init__(self) -> None:
        self.owners: list[int] = []
        self.texts: list[np.ndarray] = []
        self.windows: list[np.ndarray] = []
        self.firsts: list[int] = []

    def add(self, owner: int, text: np.ndarray, window: np.ndarray, first: int) -> None:
        if 0 < first <= len(window):
            self.owners.append(owner)
            self.texts.append(text)
            self.windows.append(window)
            self.firsts.append(first)

    def add_edge(self, owner: int, text: np.ndarray, long: np.ndarray, threshold: float) -> None:
        """Windows shorter than the text at the beginning of ``long``; one of n characters shares at most n."""
        shortest = int(np.ceil(threshold * len(text) / (200.0 - threshold)))
        self.add(owner, text, long[: len(text) - 1], max(shortest, 1))

    def settle(self, found: np.ndarray, threshold: float) -> None:
        """Compare texts of about one length together, and mark the owners of similar pairs."""
        if not self.owners:
            return
        owners, firsts = np.array(self.owners), np.array(self.firsts)
        widths = np.array([-(-len(t) // 64) for t in self.texts])
        for width in np.unique(widths):
            places = np.flatnonzero(widths == width)
            most = max(_BLOCK_CHARS // (64 * int(width)), 1)
            for block in (places[i : i + most] for i in range(0, len(places), most)):
                hit = _reach([self.texts[i] for i in block], [self.windows[i] for i in block], firsts[block], threshold)
                found[owners[block[hit]]] = True


class LongText:
    """A text prepared once for many quotes: the codes of its runs of characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._runs: dict[int, np.ndarray] = {}

    @cached_property
    def numbers(self) -> set[str]:
        return set(re.findall(r"\d+", self.text))

    @cached_property
    def points(self) -> np.ndarray:
        return _points(self.text)

    @cached_property
    def threes(self) -> tuple[np.ndarray, ...]:
        """The distinct runs of three, and the run of each place."""
        return np.unique(_grams(self.points, 3), return_inverse=True)

    @cached_property
    def fours(self) -> tuple[np.ndarray, ...]:
        """The distinct runs of four, where each stands first, and the run of each place."""
        return np.unique(_grams(self.points, 4), return_index=True, return_inverse=True)

    def reaches(self, quote: str, threshold: float = FUZZY_THRESHOLD) -> bool:
        """Whether some window is at least ``threshold`` percent similar to ``quote``."""
        return bool(similar([(quote, self)], threshold)[0])

    def runs(self, level: int) -> np.ndarray:
        """The code of the run of 2 ** level characters at each place."""
        if level not in self._runs:
            self._runs[level] = _doubled(self.points, level)
        return self._runs[level]

    def standing(self, quotes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places at which quotes of eight characters or more stand whole, and the quote of each.

        A quote is found by the code of its beginning, a power of two that is over half its length, and
        confirmed by the code of as long an end.
        """
        points = [_points(q) for q in quotes]
        sizes = np.array([len(p) for p in points])
        levels = np.frexp(sizes)[1] - 1
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        for level in np.unique(levels[(sizes >= 8) & (sizes <= len(self.points))]):
            mine = np.flatnonzero((levels == level) & (sizes <= len(self.points)))
            reach = sizes[mine] - (1 << int(level))  # from the beginning to the end part
            firsts = np.cumsum(sizes[mine]) - sizes[mine]
            parts, codes = _doubled(np.concatenate([points[i] for i in mine]), int(level)), self.runs(int(level))
            wanted, which = np.unique(parts[firsts], return_inverse=True)
            at, begins = _places(codes, wanted)
            counts = np.diff(begins)[which]
            block = np.cumsum(counts) // _BLOCK_PLACES
            for some in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(block)) + 1):
                owner, number = _counted(counts[some])
                owner = some[owner]
                place = at[begins[which[owner]] + number]
                ends = place + reach[owner]
                inside = ends < len(codes)
                owner, place, ends = owner[inside], place[inside], ends[inside]
                same = codes[ends] == parts[firsts[owner] + reach[owner]]
                found.append((mine[owner[same]], place[same]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def likely_starts(self, quotes: list[np.ndarray]) -> np.ndarray:
        """For each quote (no longer than the text) starts of windows to try first, and -1 where there are no more.

        These are the places of its rarest run of 16 characters, or else of eight; a quote without any gets the
        start that most of its runs of four agree on.
        """
        sizes = np.array([len(q) for q in quotes])
        starts = np.full((len(quotes), _LIKELY), -1, dtype=np.int64)
        for level in (4, 3):
            size = 1 << level
            mine = np.flatnonzero((starts[:, 0] < 0) & (sizes >= size))
            if not len(mine):
                continue
            firsts = np.cumsum(sizes[mine]) - sizes[mine]
            asked = (sizes[mine] - size) // (size // 2) + 1
            owner, number = _counted(asked)
            offset = number * (size // 2)
            codes = _doubled(np.concatenate([quotes[i] for i in mine]), level)[firsts[owner] + offset]
            wanted, which = np.unique(codes, return_inverse=True)
            at, begins = _places(self.runs(level), wanted)
            counts = np.diff(begins)[which]
            rank = np.where(counts > 0, counts, len(at) + 1) * len(owner) + np.arange(len(owner))
            rarest = np.minimum.reduceat(rank, np.cumsum(asked) - asked) % len(owner)
            for turn in range(_LIKELY):
                more = counts[rarest] > turn
                run = rarest[more]
                latest = len(self.points) - sizes[mine[more]]
                starts[mine[more], turn] = np.clip(at[begins[which[run]] + turn] - offset[run], 0, latest)
        mine = np.flatnonzero(starts[:, 0] < 0)
        if len(mine):
            starts[mine, 0] = self._voted_starts([quotes[i] for i in mine])
        return starts

    def _voted_starts(self, quotes: list[np.ndarray]) -> np.ndarray:
        """For each quote the start that most of its runs of four agree on."""
        sizes = np.array([len(q) for q in quotes])
        starts = np.zeros(len(quotes), dtype=np.int64)
        codes, firsts, _ = self.fours
        wanted = _grams(np.concatenate(quotes), 4)
        if not len(codes) or not len(wanted):
            return starts
        owner = np.repeat(np.arange(len(quotes)), sizes)[: len(wanted)]
        offset = np.arange(len(wanted)) - (np.cumsum(sizes) - sizes)[owner]
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        known = (codes[at] == wanted) & (offset + 4 <= sizes[owner])
        votes, counts = np.unique(owner[known] << 40 | firsts[at[known]] - offset[known] + (1 << 39), return_counts=True)
        order = np.argsort(counts, kind="stable")  # the last one written, the most voted, stays
        starts[votes[order] >> 40] = (votes[order] & (1 << 40) - 1) - (1 << 39)
        return np.clip(starts, 0, len(self.points) - sizes)

    def promising(self, quote: np.ndarray) -> tuple[np.ndarray, bool, bool]:
        """Starts of full windows that share enough character runs with the quote, the most first,
        and whether shorter windows at the beginning and at the end may.

        At 90 percent at most a tenth of the window's characters are unmatched, each breaking up
        to k of its k-runs, and at most a tenth of the quote's are left out, each breaking up to
        k - 1. So of its size - k + 1 runs at least size - k + 1 - (2k - 1) * size / 10 survive.
        A window of n < size characters leaves out at most 0.55 n - 0.45 size of its own and
        0.55 size - 0.45 n of the quote's, and is at least 9/11 of size: 0.45 size - 2 of its
        3-runs survive.
        """
        size = len(quote)
        windows = len(self.points) - size + 1
        passed, shared = np.ones(windows, dtype=bool), np.zeros(windows, dtype=np.int64)
        head = tail = True
        for k in (3, 4):
            needed = size - k + 1 - (2 * k - 1) * size // 10 - 1
            if needed <= 0:
                continue
            codes, *_, place = self.threes if k == 3 else self.fours
            wanted = _grams(quote, k)
            at = np.searchsorted(codes, wanted)
            inside = at < len(codes)
            known = at[inside][codes[at[inside]] == wanted[inside]]
            present = np.zeros(len(codes), dtype=bool)
            present[known] = True
            hits = np.concatenate(([0], np.cumsum(present[place])))
            shared = hits[size - k + 1 :] - hits[:windows]
            passed &= shared >= needed
            if k == 3:
                edge = max(size - 1 - k + 1, 0)
                head, tail = (n >= 0.45 * size - 3 for n in (hits[edge], hits[-1] - hits[len(hits) - 1 - edge]))
            if not (head or tail or passed.any()):
                break
        starts = np.flatnonzero(passed)
        return starts[np.argsort(-shared[starts], kind="stable")], head, tail


def similar(pairs: list[tuple[str, LongText]], threshold: float = FUZZY_THRESHOLD) -> np.ndarray:
    """For each pair whether some window of the text is at least ``threshold`` percent similar to the quote.

    Windows that the quotes' runs point to are compared first; what these leave open goes through the
    filter, and every window that passes it is compared.
    """
    found = np.zeros(len(pairs), dtype=bool)
    asked: list[tuple[int, np.ndarray, LongText]] = []
    for i, (quote, page) in enumerate(pairs):
        if quote and page.text:
            swapped = len(quote) > len(page.text)
            asked.append((i, page.points, LongText(quote)) if swapped else (i, _points(quote), page))
    by_page: dict[int, list[tuple[int, np.ndarray, LongText]]] = {}
    for question in asked:
        by_page.setdefault(id(question[2]), []).append(question)
    tried: list[tuple[int, np.ndarray, np.ndarray, list[int]]] = []
    for questions in by_page.values():
        points = questions[0][2].points
        starts = questions[0][2].likely_starts([text for _, text, _ in questions]).tolist()
        tried += [(i, text, points, first) for (i, text, _), first in zip(questions, starts)]
    for turn in range(_LIKELY):
        trials = _Trials()
        for i, text, points, starts in tried:
            if starts[turn] < 0 or found[i]:
                continue
            window = points[starts[turn] : starts[turn] + len(text)]
            # characters equal in place are a common subsequence
            found[i] = 100.0 * np.count_nonzero(window == text) >= threshold * len(text)
            if not found[i]:
                trials.add(i, text, window, len(text))
        trials.settle(found, threshold)

    trials, waiting = _Trials(), []
    for i, text, page in asked:
        if found[i]:
            continue
        size, long = len(text), page.points
        starts, head, tail = page.promising(text) if threshold >= 90 else (np.arange(len(long) - size + 1), True, True)
        if len(starts):
            waiting.append((i, text, long, starts))
        for near, way in ((head, 1), (tail, -1)):
            if near:
                trials.add_edge(i, text[::way], long[::way], threshold)
            if size == len(long):
                trials.add_edge(i, long[::way], text[::way], threshold)
    trials.settle(found, threshold)
    begin = 0
    while waiting := [w for w in waiting if not found[w[0]] and begin < len(w[3])]:
        trials = _Trials()
        for i, text, long, starts in waiting:
            for start in starts[begin : begin + _WAVE]:
                trials.add(i, text, long[start : start + len(text)], len(text))
        trials.settle(found, threshold)
        begin += _WAVE
    return found


class Site:
    """The pages of a scan in their order, prepared once for many quotes."""

    def __init__(self, positions: list[int | None], urls: list[str | None], texts: list[str]) -> None:
        self.positions, self.urls = positions, urls
        self.pages = [LongText(t) for t in texts]
        # no matching form has a line break, so that nothing is found across two pages
        self.whole = LongText("\n".join(texts))
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self._claimed: dict[str | None, tuple[list[int], list[int], list[int]]] = {}

    def claimed(self, source: str | None) -> tuple[list[int], list[int], list[int]]:
        """The pages of an address, all pages at the position of the first of these, and the pages elsewhere."""
        if source not in self._claimed:
            own = [k for k, url in enumerate(self.urls) if source is not None and url == source]
            there = [k for k, p in enumerate(self.positions) if own and p == self.positions[own[0]]]
            self._claimed[source] = own, there, [k for k in range(len(self.pages)) if k not in there]
        return self._claimed[source]

    def holding(self, quotes: list[str]) -> dict[str, list[int]]:
        """For each quote that stands whole in pages, these."""
        distinct = list(dict.fromkeys(quotes))
        owner, place = self.whole.standing(distinct) if distinct else (np.empty(0, dtype=np.int64),) * 2
        # of the places in one page the first, by the text itself
        pairs, first = np.unique(owner * len(self.pages) + np.searchsorted(self.ends, place, side="right"), return_index=True)
        held: dict[str, list[int]] = {}
        for pair, start in zip(pairs.tolist(), place[first].tolist()):
            quote, page = distinct[pair // len(self.pages)], pair % len(self.pages)
            if self.whole.text.startswith(quote, start) or quote in self.pages[page].text:
                held.setdefault(quote, []).append(page)
        return held


#: A quote with the address it claims, and the scan whose pages it meets.
_Asked = tuple[str | None, str | None, Site | None]


def find_pages(asked: list[_Asked], fuzzy: bool) -> list[tuple[str | None, int | None]]:
    """For each quote its grounding and the place of the page that settles it.

    That is the claimed source if it holds the quote, even approximately; else the first page that holds
    it exactly; else the first that does approximately. A page with a number of the quote missing does not.
    """
    of_site: dict[int, list[str]] = {}
    for quote, _, site in asked:
        if quote is not None and site is not None:
            of_site.setdefault(id(site), []).append(quote)
    sites = {id(site): site for _, _, site in asked if site is not None}
    held = {key: sites[key].holding(quotes) for key, quotes in of_site.items()}

    results: list[tuple[str | None, int | None]] = [(None, None)] * len(asked)
    left: list[tuple[int, str, Site, list[int]]] = []
    for i, (quote, source, site) in enumerate(asked):
        if quote is None or site is None:
            continue
        own, there, elsewhere = site.claimed(source)
        holds = held[id(site)].get(quote, ())
        if holds and any(k in holds for k in own):
            results[i] = ("exact", own[0])
            continue
        exact = next((k for k in holds if k not in own), None)
        if exact is not None:
            results[i] = ("exact", exact)
        if fuzzy and len(quote) <= MAX_FUZZY_CHARS and (own or exact is None):
            left.append((i, quote, site, there if exact is not None else there + elsewhere))
    turn, numbers = 0, {i: re.findall(r"\d+", quote) for i, quote, _, _ in left}
    settled: set[int] = set()
    while left := [a for a in left if a[0] not in settled and turn < len(a[3])]:
        able = [a for a in left if a[2].pages[a[3][turn]].numbers.issuperset(numbers[a[0]])]
        similar_there = similar([(quote, site.pages[places[turn]]) for _, quote, site, places in able])
        for (i, _, site, places), yes in zip(able, similar_there):
            if yes:
                settled.add(i)
                at = site.positions.index(site.positions[places[turn]])
                # beside an exact match elsewhere only the source itself counts
                if results[i][0] is None or site.urls[at] == asked[i][1]:
                    results[i] = ("fuzzy", at)
        turn += 1
    return results


def page_finder(fuzzy: bool):
    """A function of the quotes of a scan (matching form, claimed address) and its pages (position, address,
    matching form): for each quote its grounding and the place of its page."""

    @F.arrow_udf("array<struct<state:string,page:int>>")
    def found_pages(quotes: pa.Array, sources: pa.Array, positions: pa.Array, urls: pa.Array, texts: pa.Array) -> pa.Array:
        states: list[str | None] = []
        places: list[int | None] = []
        waiting: list[_Asked] = []
        site, last, chars = None, None, 0

        def settle() -> None:
            for state, place in find_pages(waiting, fuzzy):
                states.append(state)
                places.append(place)
            waiting.clear()

        for k in range(len(quotes)):
            # rows of one scan follow each other, so its pages are prepared once
            if last is None or not (texts.slice(k, 1).equals(texts.slice(last, 1)) and urls.slice(k, 1).equals(urls.slice(last, 1))):
                if len(waiting) >= _CALL_QUOTES or chars >= _CALL_CHARS:
                    settle()
                    chars = 0
                page_texts = texts[k].as_py()
                site = Site(positions[k].as_py(), urls[k].as_py(), page_texts) if page_texts else None
                chars += sum(map(len, page_texts or ()))
            last = k
            waiting += [(q, source, site) for q, source in zip(quotes[k].as_py(), sources[k].as_py())]
        settle()
        values = pa.StructArray.from_arrays([pa.array(states, pa.string()), pa.array(places, pa.int32())], ["state", "page"])
        ends = np.concatenate(([0], np.cumsum([len(q) for q in quotes]))) if len(quotes) else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    return found_pages
