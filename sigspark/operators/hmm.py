"""Dynamic programming over events: kernels in NumPy, and grouped functions that run them.

Kernels take arrays and return arrays and are tested without Spark. The wrappers take one row for each piece of work, with
its events in an array, so nothing has to be grouped: a task's memory holds one piece at a time, and its matrices have
events times k-mers cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Probabilities of skipping a k-mer, of a bad event, of a further skip; of clipping at the ends; background.
P_SKIP, P_BAD, P_SKIP_SELF = 0.0025, 0.001, 0.3
START_TO_CLIP, CLIP_SELF, BACKGROUND = 0.5, 0.90, -3.0
LOG_SQRT_2PI = math.log(math.sqrt(2 * math.pi))
NONE = -np.inf
M, B, K = 0, 1, 2
STATE_NAMES = "MBK"
ALIGNED = "read_id long, event_idx int, kmer_idx int, state string"


def log_normal(x: np.ndarray, mean: np.ndarray, stdv: np.ndarray) -> np.ndarray:
    z = (x - mean) / stdv
    return -LOG_SQRT_2PI - np.log(stdv) - 0.5 * z * z


def transitions(events_per_base: float, indel_bias: float = 1.0) -> dict[str, float]:
    """Log-probabilities: from a match (to the same or next k-mer's match, a bad event, a skip), from a bad event, from a skip."""
    stay = 1 - 1 / max(1.25, events_per_base * indel_bias)
    third = (1 - P_BAD) / 3
    p = {"mm_self": stay, "mm_next": 1 - stay - P_SKIP - P_BAD, "mb": P_BAD, "mk": P_SKIP, "bb": P_BAD, "bm_self": third, "bm_next": third, "bk": third, "kk": P_SKIP_SELF, "km": 1 - P_SKIP_SELF}
    return {k: math.log(v) for k, v in p.items()}


def flanks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability that the first i events are clipped, and that the events after the i-th are."""
    i = np.arange(1, n + 1, dtype=float)
    clip = math.log(START_TO_CLIP) + math.log(1 - CLIP_SELF) + i * BACKGROUND + (i - 1) * math.log(CLIP_SELF)
    before = np.concatenate([[math.log(1 - START_TO_CLIP)], clip])
    return before, before[:n][::-1].copy()


def _sum(*ways: np.ndarray) -> np.ndarray:
    """The log of the summed exponentials, cell by cell: one logarithm, whatever the number of ways."""
    top = ways[0]
    for x in ways[1:]:
        top = np.maximum(top, x)
    base = np.where(top == NONE, 0.0, top)
    total = np.exp(ways[0] - base)
    for x in ways[1:]:
        total += np.exp(x - base)
    return np.log(total) + base


def _running_sum(x: np.ndarray) -> np.ndarray:
    """The same of all cells of a row up to each. A row whose cells lie too far apart for one scale goes cell by cell."""
    top = x.max(axis=1, keepdims=True)
    base = np.where(top == NONE, 0.0, top)
    out = np.log(np.cumsum(np.exp(x - base), axis=1)) + base
    far = ((x < base - 700) & (x > NONE)).any(axis=1)
    if far.any():
        out[far] = np.logaddexp.accumulate(x[far], axis=1)
    return out


def _score(emission, n: np.ndarray, k: np.ndarray, lp: dict[str, np.ndarray], pre_clip: bool, post_clip: bool, best: bool) -> np.ndarray:
    """For a block of reads, each with n events (most first) and k k-mers: log-probability of the best path (best) or of all
    paths. emission(i, a): of the first a reads' i-th events, a x most k-mers. Two rows are held, whatever the number of
    events; their first column stands for what lies before the first k-mer."""
    size, most_n, most_k = len(n), int(n[0]), int(k.max())
    join = (lambda *x: np.maximum.reduce(x)) if best else _sum
    scan = (lambda x: np.maximum.accumulate(x, axis=1)) if best else _running_sum
    last, row = np.full((3, size, most_k + 1), NONE), np.full((3, size, most_k + 1), NONE)
    first = flanks(most_n)[0]
    end = np.full(size, NONE)
    steps = np.arange(most_k) * lp["kk"]
    beyond = np.arange(most_k) >= k[:, None] if k.min() < most_k else None
    active = np.searchsorted(-n, -np.arange(most_n), "left").tolist()
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        for r, a in enumerate(active):
            m, b, s = last[:, :a]
            p = {x: v[:a] for x, v in lp.items()}
            x = join(m[:, 1:] + p["mm_self"], m[:, :-1] + p["mm_next"], b[:, 1:] + p["bm_self"], b[:, :-1] + p["bm_next"], s[:, :-1] + p["km"])
            if r == 0 or pre_clip:
                x[:, 0] = join(x[:, 0], np.full(a, first[r]))
            row[M, :a, 1:] = x + emission(r, a)
            row[B, :a, 1:] = join(m[:, 1:] + p["mb"], b[:, 1:] + p["bb"])
            # A skip emits nothing: it comes from the k-mer before in the same row, so it is a scan, here of start less its own steps.
            start = join(row[M, :a, :-1] + p["mk"], row[B, :a, :-1] + p["bk"]) - steps[:a]
            if beyond is not None:
                start[beyond[:a]] = NONE
            row[K, :a, 1:] = scan(start) + steps[:a]
            at = np.arange(a) if post_clip else np.flatnonzero(n[:a] == r + 1)
            if len(at):
                x = row[:, at, k[at]] + first[n[at] - r - 1]
                end[at] = join(end[at], *x)
            last, row = row, last
    return end


def _trace(emission, n: np.ndarray, k: np.ndarray, lp: dict[str, np.ndarray], pre_clip: bool, post_clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """For a block of reads, each with n events and k k-mers: the origins of the best paths' cells (event from 1, read, state,
    k-mer), -1 where no path leads, and the best scores. emission(i): of all reads' i-th events, reads x most k-mers; what
    lies beyond a read's own events and k-mers touches none of its cells. Two rows of scores are held."""
    size, most_n, most_k = len(n), int(n.max()), int(k.max())
    origin = np.full((most_n + 1, size, 3, most_k), -1, dtype=np.int8)
    last, row = np.full((3, size, most_k + 1), NONE), np.full((3, size, most_k + 1), NONE)
    first = flanks(most_n)[0]
    end = np.full(size, NONE)
    steps = np.arange(most_k) * lp["kk"]

    def choose(out, *ways):
        out[:] = ways[0]
        came = np.zeros(out.shape, dtype=np.int8)
        for i, x in enumerate(ways[1:], 1):
            came[x >= out] = i  # of equals the later
            np.maximum(out, x, out=out)
        return came

    with np.errstate(divide="ignore", invalid="ignore"):
        for r in range(1, most_n + 1):
            m, b, s = last
            match, bad, skip = row[:, :, 1:]
            came = choose(match, lp["mm_self"] + m[:, 1:], lp["mm_next"] + m[:, :-1], lp["bm_self"] + b[:, 1:], lp["bm_next"] + b[:, :-1], lp["km"] + s[:, :-1])
            if r == 1 or pre_clip:
                came[first[r - 1] >= match[:, 0], 0] = 5
                match[:, 0] = np.maximum(match[:, 0], first[r - 1])
            match += emission(r - 1)
            origin[r, :, M] = np.where(match > NONE, came, -1)
            came = choose(bad, lp["mb"] + m[:, 1:], lp["bb"] + b[:, 1:])
            origin[r, :, B] = np.where(bad > NONE, came, -1)
            from_m, from_b = lp["mk"] + row[M, :, :-1], lp["bk"] + row[B, :, :-1]
            start = np.maximum(from_m, from_b)
            skip[:] = np.maximum.accumulate(start - steps, axis=1) + steps
            came = np.where(lp["kk"] + row[K, :, :-1] >= start, 2, from_b >= from_m)
            origin[r, :, K] = np.where(skip > NONE, came, -1)
            at = np.flatnonzero(n >= r if post_clip else n == r)
            x = row[:, at, k[at]].max(axis=0) + first[n[at] - r]
            end[at] = np.where(x > end[at], x, end[at])
            last, row = row, last
    return origin, end


def _traced(origin: np.ndarray, n: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each read's path back from the last event's match of the last k-mer: arrays of events, k-mers, states, in order."""
    r, j, s = n.copy(), k - 1, np.zeros(len(n), dtype=np.int64)
    going, path = np.arange(len(n)), []
    event, kmer = np.array([[1, 1, 1, 1, 1, 0], [1, 1, 0, 0, 0, 0], [0] * 6]), np.array([[0, 1, 0, 1, 1, 0], [0] * 6, [1, 1, 1, 0, 0, 0]])
    state = np.array([[M, M, B, B, K, M], [M, B, 0, 0, 0, 0], [M, B, K, 0, 0, 0]])
    while len(going):
        o = origin[r[going], going, s[going], j[going]]
        going, o = going[o >= 0], o[o >= 0]
        path.append((going, r[going] - 1, j[going], s[going]))
        going, o = going[(s[going] != M) | (o != 5)], o[(s[going] != M) | (o != 5)]
        at = s[going], o
        r[going] -= event[at]
        j[going] -= kmer[at]
        s[going] = state[at]
        going = going[(r[going] > 0) & (j[going] >= 0)]
    of, *cells = (np.concatenate(c)[::-1] for c in zip(*path, strict=True))
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(n) + 1)).tolist()
    cells = [c[order] for c in cells]
    return [tuple(c[a:b] for c in cells) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _alone(emission: np.ndarray, lp: dict[str, float], pre_clip: bool, post_clip: bool, best: bool) -> float:
    n, k = (np.array([x]) for x in emission.shape)
    return float(_score(lambda i, _: emission[i], n, k, {x: np.full((1, 1), v) for x, v in lp.items()}, pre_clip, post_clip, best)[0])


def score_many(work: list[tuple], pre_clip: bool = False, post_clip: bool = False, best: bool = False) -> np.ndarray:
    """forward, or best_score, of many reads (means, level_mean, level_stdv, events_per_base; none empty). Reads of like numbers of
    k-mers go through their rows together."""
    out = np.empty(len(work))
    for block in blocks([len(a) for _, a, *_ in work], 1 << 20, 64):
        block.sort(key=lambda i: -len(work[i][0]))
        means, mean, stdv, n, k, lp = _block([work[i] for i in block])
        out[block] = _score(emissions(means, mean, stdv), n, k, lp, pre_clip, post_clip, best)
    return out


def _block(work: list[tuple]) -> tuple:
    """Reads as matrices: means, level_mean, level_stdv; numbers of events and k-mers; transitions, a column each."""
    every = {e: transitions(e) for _, _, _, e in work}
    lp = {x: np.array([every[e][x] for *_, e in work])[:, None] for x in every[work[0][3]]}
    return *(padded([w[i] for w in work], fill) for i, fill in ((0, 0.0), (1, 0.0), (2, 1.0))), *(np.array([len(w[i]) for w in work]) for i in (0, 1)), lp


def emissions(means: np.ndarray, level_mean: np.ndarray, level_stdv: np.ndarray):
    """A function of i, and a: log_normal of the first a (or all) reads' i-th events under each of their k-mers."""
    with np.errstate(divide="ignore", invalid="ignore"):
        constant = -LOG_SQRT_2PI - np.log(level_stdv)

    def emission(i: int, a: int | None = None) -> np.ndarray:
        z = (means[:a, i, None] - level_mean[:a]) / level_stdv[:a]
        return constant[:a] - 0.5 * z * z

    return emission


def forward(emission: np.ndarray, events_per_base: float, pre_clip: bool = False, post_clip: bool = False, indel_bias: float = 1.0) -> float:
    """Log-probability of all events under the k-mers' model."""
    if not emission.size:
        return NONE
    return _alone(emission, transitions(events_per_base, indel_bias), pre_clip, post_clip, False)


def best_score(emission: np.ndarray, events_per_base: float, pre_clip: bool = False, post_clip: bool = False, indel_bias: float = 1.0) -> float:
    """Log-probability of the best path alone."""
    if not emission.size:
        return NONE
    return _alone(emission, transitions(events_per_base, indel_bias), pre_clip, post_clip, True)


def viterbi(emission: np.ndarray, events_per_base: float, pre_clip: bool = False, post_clip: bool = False, indel_bias: float = 1.0) -> tuple[float, list[tuple[int, int, str]]]:
    """Score of the best path, and the path traced from the last event's match of the last k-mer: (event, k-mer, state)."""
    if not emission.size:
        return NONE, []
    n, k = (np.array([x]) for x in emission.shape)
    origin, end = _trace(lambda i: emission[i], n, k, transitions(events_per_base, indel_bias), pre_clip, post_clip)
    return float(end[0]), [(r, j, STATE_NAMES[s]) for r, j, s in zip(*(c.tolist() for c in _traced(origin, n, k)[0]), strict=True)]


def viterbi_many(work: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """viterbi's paths of many reads (means, level_mean, level_stdv, events_per_base; none empty), without clipping: arrays of
    events, k-mers, states. Reads of like size go through their rows together."""
    out: list = [None] * len(work)
    for block in blocks([len(m) * len(a) for m, a, *_ in work], 1 << 23):
        unlike = max(len(work[i][0]) for i in block) * max(len(work[i][1]) for i in block) * len(block) > 1 << 25
        for part in [[i] for i in block] if unlike else [block]:
            means, mean, stdv, n, k, lp = _block([work[i] for i in part])
            origin, _ = _trace(emissions(means, mean, stdv), n, k, lp, False, False)
            for i, x in zip(part, _traced(origin, n, k), strict=True):
                out[i] = x
    return out


def forward_of_set(emissions: list[np.ndarray], events_per_base: float) -> float:
    """Mean likelihood over alternative sequences, as a log."""
    return float(np.logaddexp.reduce([forward(e, events_per_base) for e in emissions]) - math.log(len(emissions)))


def banded_align(means: np.ndarray, level_mean: np.ndarray, level_stdv: np.ndarray, bandwidth: int = 100, min_emission: float = -5.0, max_gap: int = 50) -> tuple[list[tuple[int, int]], dict]:
    """Events to k-mers along a band that follows the better of its ends: pairs (k-mer, event), empty if the alignment is
    poor, doesn't reach both ends or jumps too far; and its quality figures."""
    if not len(means) or not len(level_mean):
        return [], {"ok": False}
    kmer, event, figures = banded_align_many([(means, level_mean, level_stdv)], bandwidth, min_emission, max_gap)[0]
    return list(zip(kmer.tolist(), event.tolist(), strict=True)), figures


def padded(rows: list[np.ndarray], fill: float = 0.0) -> np.ndarray:
    """Rows of different lengths as one matrix."""
    out = np.full((len(rows), max(map(len, rows))), fill)
    for x, r in zip(out, rows, strict=True):
        x[: len(r)] = r
    return out


def blocks(cells: list[int], most: int, rows: int = 256) -> Iterator[list[int]]:
    """The numbers of pieces of work, those of like size together: a block has at most rows of them, and its largest times their number
    is at most most, or it is one piece."""
    block: list[int] = []
    for i in sorted(range(len(cells)), key=cells.__getitem__):
        if block and (len(block) == rows or cells[i] * (len(block) + 1) > most):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def banded_align_many(work: list[tuple], bandwidth: int = 100, min_emission: float = -5.0, max_gap: int = 50) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    """banded_align of many reads (means, level_mean, level_stdv; none empty), read by read the same: arrays of k-mers and events,
    and the figures. Reads of like length go along their bands together; of a band's cells only their origins are kept."""
    out: list = [None] * len(work)
    for block in blocks([(len(m) + len(a) + 2) * bandwidth for m, a, _ in work], 1 << 25):
        for i, x in zip(block, _banded_block([work[i] for i in block], bandwidth, min_emission, max_gap), strict=True):
            out[i] = x
    return out


def _banded_block(work: list[tuple], bandwidth: int, min_emission: float, max_gap: int) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    means, level_mean, level_stdv = (padded([np.asarray(w[i], dtype=float) for w in work], fill) for i, fill in ((0, 0.0), (1, 0.0), (2, 1.0)))
    n, k = (np.array([len(w[i]) for w in work]) for i in (0, 1))
    size, half = len(work), bandwidth // 2
    per_base = [(a / b + 1) for a, b in zip(n.tolist(), k.tolist(), strict=True)]
    skip, trim = math.log(1e-10), math.log(0.01)
    stays = [math.log(1 - 1 / x) for x in per_base]
    stay, step = np.array(stays)[:, None], np.array([math.log(1 - math.exp(skip) - math.exp(x)) for x in stays])[:, None]
    bands = int((n + k).max()) + 2
    with np.errstate(divide="ignore", invalid="ignore"):
        constant = -LOG_SQRT_2PI - np.log(level_stdv)
    origin = np.zeros((bands, size, bandwidth), dtype=np.uint8)  # 0 diagonal, 1 event alone, 2 k-mer alone
    event0, kmer0 = np.zeros((bands, size), dtype=np.int64), np.zeros((bands, size), dtype=np.int64)  # of the band's lower left cell
    event0[0], kmer0[0] = half - 1, -1 - half
    event0[1], kmer0[1] = half, -1 - half
    # A band's scores stand between two cells that no path reaches.
    older, last = np.full((size, bandwidth + 2), NONE), np.full((size, bandwidth + 2), NONE)
    older[:, 1 + half] = 0.0
    last[:, 1 + half] = trim
    origin[1, :, half] = 1
    cells, reads = np.arange(bandwidth), np.arange(size)
    event_at, kmer_at = (reads * means.shape[1])[:, None], (reads * level_mean.shape[1])[:, None]
    ends = np.full(means.shape, NONE)  # scores of the last k-mer's cells

    def ended(b, score):
        e = b - k - 1
        o = event0[b] - e
        r = np.flatnonzero((e >= 0) & (e < n) & (o >= 0) & (o < bandwidth))
        ends[r, e[r]] = score[r, 1 + o[r]]

    with np.errstate(divide="ignore", invalid="ignore"):
        for b in range(2, bands):
            low, high = last[:, 1], last[:, -2]
            right = np.where((low == NONE) & (high == NONE), b % 2 == 1, low < high)
            event0[b], kmer0[b] = event0[b - 1] + ~right, kmer0[b - 1] + right
            e, j = event0[b][:, None] - cells, kmer0[b][:, None] + cells
            valid = (e >= 0) & (e < n[:, None]) & (j >= 0) & (j < k[:, None])
            at_kmer = kmer_at + np.clip(j, 0, (k - 1)[:, None])
            z = (means.ravel()[event_at + np.clip(e, 0, (n - 1)[:, None])] - level_mean.ravel()[at_kmer]) / level_stdv.ravel()[at_kmer]
            emit = constant.ravel()[at_kmer] - 0.5 * z * z
            to_right, moved = right[:, None], (kmer0[b] - kmer0[b - 2])[:, None]
            diagonal = np.where(moved == 1, older[:, 1:-1], np.where(moved == 2, older[:, 2:], older[:, :-2])) + step + emit
            event = np.where(to_right, last[:, 2:], last[:, 1:-1]) + stay + emit
            kmer = np.where(to_right, last[:, 1:-1], last[:, :-2]) + skip
            best = np.maximum(diagonal, event)
            o = np.where((event >= diagonal) | (event != event), 1, 0)
            origin[b] = np.where(valid, np.where((kmer >= best) | (kmer != kmer), 2, o), 0)
            older, last = last, older
            last[:, 1:-1] = np.where(valid, np.maximum(best, kmer), NONE)
            t = -1 - kmer0[b]
            r = np.flatnonzero((t >= 0) & (t < bandwidth) & (event0[b] - t >= 0) & (event0[b] - t < n))
            last[r, 1 + t[r]] = trim * (event0[b][r] - t[r] + 1)
            origin[b, r, t[r]] = 1
            ended(b, last)

    x = ends + (n[:, None] - np.arange(means.shape[1])) * trim
    x[np.isnan(x)] = NONE
    event = x.argmax(axis=1)
    best = x[reads, event]
    kmer = k - 1
    gap, widest = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    going, path = reads, []
    while len(going):
        path.append((going, kmer[going], event[going]))
        b = event[going] + kmer[going] + 2
        o = event0[b, going] - event[going]
        inside = (o >= 0) & (o < bandwidth)
        going, b, o = going[inside], b[inside], o[inside]
        o = origin[b, going, o]
        alone = o == 2
        gap[going] = np.where(alone, gap[going] + 1, 0)
        widest[going] = np.maximum(widest[going], gap[going])
        event[going] -= ~alone
        kmer[going] -= o != 1
        going = going[(kmer[going] >= 0) & (event[going] >= 0)]
    r, kmer, event = (np.concatenate(c)[::-1] for c in zip(*path, strict=True))
    by_read = np.argsort(r, kind="stable")
    bounds = np.searchsorted(r[by_read], np.arange(size + 1)).tolist()
    kmer, event = kmer[by_read], event[by_read]
    r = r[by_read]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (means[r, event] - level_mean[r, kmer]) / level_stdv[r, kmer]
        emission = constant[r, kmer] - 0.5 * z * z
    out = []
    for i, (a, c) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        mean = float(np.cumsum(emission[a:c][::-1])[-1]) / (c - a)
        ok = bool(mean >= min_emission and kmer[a] == 0 and widest[i] <= max_gap)
        out.append((kmer[a : c if ok else a], event[a : c if ok else a], {"ok": ok, "mean_emission": mean, "max_gap": int(widest[i]), "score": float(best[i])}))
    return out


def segment(samples: np.ndarray, mixed_tail: bool = False) -> np.ndarray:
    """The likeliest state of each scaled sample, START to TRANSCRIPT; the last is TRANSCRIPT. mixed_tail: the tail's samples
    are of either of the two kinds of tail."""
    from .signal import BITS, EMISSIONS, STATES, TRANSITIONS

    x = np.where((samples > 200) | (samples < 40), 100.0, samples)
    pdf = lambda m, s: np.exp(log_normal(x, m, s))
    e = np.full((len(x), 6), NONE)
    m, s, w, flat = EMISSIONS["START"]
    with np.errstate(divide="ignore"):
        e[:, 0] = np.log(w * pdf(m, s) + (1 - w) * flat)
        e[:, 1] = log_normal(x, *EMISSIONS["LEADER"])
        for i, name in ((2, "ADAPTER"), (5, "TRANSCRIPT")):
            a, b, w, c, d = EMISSIONS[name]
            e[:, i] = np.log(w * pdf(a, b) + (1 - w) * pdf(c, d))
        e[:, 3] = np.log(0.5 * pdf(*BITS["polya"]) + 0.5 * pdf(*BITS["polyi"])) if mixed_tail else log_normal(x, *EMISSIONS["POLYA"])
        low, high, level = EMISSIONS["CLIFF"]
        e[:, 4] = np.where((x > low) & (x < high), level, NONE)
        trans = np.log(np.array([[TRANSITIONS.get((a, b), 0.0) for b in STATES] for a in STATES]))
    v, back = np.full(6, NONE), np.zeros((len(x), 6), dtype=np.int8)
    v[0] = e[0, 0]
    for t in range(1, len(x)):
        ways = v[:, None] + trans
        back[t] = ways.argmax(axis=0)
        v = ways.max(axis=0) + e[t]
    labels = np.zeros(len(x), dtype=np.int8)
    labels[-1] = 5
    for t in range(len(x) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def regions(labels: np.ndarray) -> dict[str, int]:
    """Last sample of start, leader, adapter and tail, and the number of cliffs; the last three samples where one is missing."""
    ends = {}
    for name, a, b in (("start", 0, 1), ("leader", 1, 2), ("adapter", 2, 3), ("polya", 3, 5)):
        at = np.flatnonzero((labels[:-1] == a) & (labels[1:] == b))
        ends[name] = int(at[-1]) if len(at) else None
    n = len(labels)
    if ends["leader"] is None or ends["adapter"] is None or ends["polya"] is None:
        ends |= {"leader": n - 3, "adapter": n - 2, "polya": n - 1}
    return {k: 0 if v is None else v for k, v in ends.items()} | {"cliffs": int((labels == 4).sum())}


def switch(bits: np.ndarray) -> tuple[int, int]:
    """Last index of the first state and first of the second in the best path of a two-state chain; -1 if absent. The chain
    switches at most once, so the best switch is the largest of prefix sums."""
    from .signal import ONES_A, ONES_I, STAY_I

    if not len(bits):
        return -1, -1
    lp = lambda p: np.where(bits == 1, math.log(p), math.log(1 - p))
    first, second = np.cumsum(lp(ONES_I)), lp(ONES_A)
    n = len(bits)
    after = np.concatenate([np.cumsum(second[::-1])[::-1], [0.0]])
    at = np.arange(1, n)  # first index of the second state
    stay = first[n - 1] + (n - 1) * math.log(STAY_I)
    if n == 1:
        return 0, -1
    moved = first[at - 1] + (at - 1) * math.log(STAY_I) + math.log(1 - STAY_I) + after[at]
    j = len(moved) - 1 - int(moved[::-1].argmax())
    return (n - 1, -1) if stay >= moved[j] else (int(at[j]) - 1, int(at[j]))


def train_mixture(x: np.ndarray, read_var: np.ndarray, weights: np.ndarray, means: np.ndarray, stdvs: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation of a Gaussian mixture whose deviations each datum scales by its read's factor."""
    weights, means, stdvs = (np.asarray(a, dtype=float).copy() for a in (weights, means, stdvs))
    for _ in range(rounds):
        lp = np.log(weights) + log_normal(x[:, None], means, stdvs * read_var[:, None])
        r = np.exp(lp - np.logaddexp.reduce(lp, axis=1)[:, None])
        n = r.sum(axis=0)
        weights = n / n.sum()
        means = (r * x[:, None]).sum(axis=0) / n
        stdvs = np.sqrt((r * ((x[:, None] - means) / read_var[:, None]) ** 2).sum(axis=0) / n)
    return weights, means, stdvs


def haplotype_frequencies(scores: np.ndarray, passes: int = 4) -> np.ndarray:
    """Expectation-maximisation of haplotype frequencies from a reads x haplotypes matrix of log-likelihoods."""
    f = np.full(scores.shape[1], 1 / scores.shape[1])
    for _ in range(passes):
        with np.errstate(divide="ignore"):
            lp = np.log(f) + scores
        p = np.exp(lp - np.logaddexp.reduce(lp, axis=1)[:, None])
        f = p.mean(axis=0)
    return f


def longest_common_kmers(a: str, b: str, k: int = 5) -> list[tuple[int, int]]:
    """The longest chain of k-mers that both sequences hold in order: pairs of positions."""
    n, m = len(a) - k + 1, len(b) - k + 1
    if n <= 0 or m <= 0:
        return []
    best = np.zeros((n + 1, m + 1), dtype=np.int32)
    number: dict[str, int] = {}
    ka, kb = (np.array([number.setdefault(x[i : i + k], len(number)) for i in range(len(x) - k + 1)]) for x in (a, b))
    for i in range(n - 1, -1, -1):
        diagonal = np.where(kb == ka[i], best[i + 1, 1:] + 1, 0)
        row = np.maximum(best[i + 1, :-1], diagonal)
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    out = []
    while i < n and j < m:
        if ka[i] == kb[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_chained(means: np.ndarray, level_mean: np.ndarray, level_stdv: np.ndarray, anchors: list[tuple[int, int]], events_per_base: float, stride: int = 100, emit: int = 50) -> list[tuple[int, int, str]]:
    """A long read along its reference, stretch by stretch: between an anchor (k-mer, event) and the next one at least stride
    k-mers on, the best path; of it the first emit events count, and the next stretch begins at the last of them. Matrices
    stay small however long the read is. Returns (event, k-mer, state)."""
    event, kmer, state = align_chained_many([(means, level_mean, level_stdv, anchors, events_per_base)], stride, emit)[0]
    return [(e, k, STATE_NAMES[s]) for e, k, s in zip(event.tolist(), kmer.tolist(), state.tolist(), strict=True)]


def align_chained_many(work: list[tuple], stride: int = 100, emit: int = 50) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """align_chained of many reads, read by read the same: arrays of events, k-mers, states. All reads' next stretches are aligned
    together."""
    empty = np.empty(0, dtype=np.int64)
    out = [[(empty, empty, empty)] for _ in work]
    anchors = [sorted(w[3]) for w in work]
    at = [0] * len(work)
    place = [x[0] if len(x) > 1 else None for x in anchors]
    going = [i for i, x in enumerate(place) if x]
    while going:
        todo = []
        for i in going:
            (kmer, event), known = place[i], anchors[i]
            if event >= known[-1][1]:
                continue
            while at[i] < len(known) - 1 and (known[at[i]][0] < kmer + stride or known[at[i]][1] <= event):
                at[i] += 1
            end_kmer, end_event = known[at[i]]
            if end_event > event and end_kmer >= kmer:
                m, a, s, _, e = work[i]
                todo.append((i, (m[event : end_event + 1], a[kmer : end_kmer + 1], s[kmer : end_kmer + 1], e)))
        going = []
        for (i, _), path in zip(todo, viterbi_many([x for _, x in todo]), strict=True):
            kmer, event = place[i]
            emitted = path[2] != K
            e, k, s = (c[emitted][len(out[i]) > 1 :] for c in path)  # without the event that both stretches share
            if at[i] < len(anchors[i]) - 1 and len(e):
                e, k, s = e[:emit], k[:emit], s[:emit]
                going.append(i)
                place[i] = kmer + int(k[-1]), event + int(e[-1])
            if len(e):
                out[i].append((event + e, kmer + k, s))
    return [tuple(np.concatenate(c) for c in zip(*x, strict=True)) for x in out]


# ---- over DataFrames ----


def mapped(df: DataFrame, row, schema: str) -> DataFrame:
    """Runs row(dict) -> list of dicts over every row, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out = [o for r in b.slice(i, 64).to_pylist() for o in row(r)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(task, schema)


def lists(column: pa.Array) -> list[np.ndarray]:
    """Each row's numbers; a null row has none, a null number is NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def by_read(reads: pa.Array, rows: list[int], found: list[tuple]) -> list[pa.Array]:
    """The reads' names beside what was found for the given rows: a tuple of arrays each, of one length."""
    if not rows:
        return []
    names = reads.take(pa.array(np.repeat(rows, [len(x[0]) for x in found])))
    return [names, *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))]


def pieces_of_work(b: pa.RecordBatch, mean: str, stdv: str, events_per_base: list[float]) -> tuple[list[tuple], list[int]]:
    """Work as score_many takes it, and its rows: those with events and k-mers."""
    work = [*zip(*(lists(b.column(c)) for c in ("means", mean, stdv)), events_per_base, strict=True)]
    some = [i for i, (m, a, *_) in enumerate(work) if len(m) and len(a)]
    return [work[i] for i in some], some


def batched(df: DataFrame, rows, schema: str, most: int = 512, values: int = 1 << 21) -> DataFrame:
    """Runs rows(Arrow batch) -> columns over slices of at most most rows and about so many values of their lists, or one row."""
    from pyspark.sql.types import _parse_datatype_string

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches):
        for b in batches:
            size = np.zeros(b.num_rows, dtype=np.int64)
            for c in b.columns:
                if pa.types.is_list(c.type):
                    size += pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
            size = np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < b.num_rows:
                n = min(max(int(np.searchsorted(size, size[i] + values, "right")) - 1 - i, 1), most, b.num_rows - i)
                if out := rows(b.slice(i, n)):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                i += n

    return df.mapInArrow(task, schema)


def score_reads(work: DataFrame, pre_clip: bool = False, post_clip: bool = False) -> DataFrame:
    """read_id, n_events, n_kmers, forward score, best path's score. work: read_id, means, level_mean, level_stdv (arrays),
    events_per_base."""

    def rows(b):
        work, some = pieces_of_work(b, "level_mean", "level_stdv", b.column("events_per_base").to_pylist())
        sizes = (pa.array([len(x[i]) for x in work]) for i in (0, 1))
        return [b.column("read_id").take(pa.array(some)), *sizes, *(pa.array(score_many(work, pre_clip, post_clip, best)) for best in (False, True))] if some else []

    return batched(work.select("read_id", "means", "level_mean", "level_stdv", "events_per_base"), rows, "read_id long, n_events int, n_kmers int, forward double, viterbi double")


def align_reads(work: DataFrame) -> DataFrame:
    """The best path of each read: read_id, event, k-mer, state."""

    def rows(b):
        work, some = pieces_of_work(b, "level_mean", "level_stdv", b.column("events_per_base").to_pylist())
        return _stated(by_read(b.column("read_id"), some, viterbi_many(work)))

    return batched(work.select("read_id", "means", "level_mean", "level_stdv", "events_per_base"), rows, ALIGNED)


def _stated(columns: list[pa.Array]) -> list[pa.Array]:
    return [*columns[:3], pa.array(list(STATE_NAMES)).take(columns[3])] if columns else []


def align_banded(work: DataFrame, bandwidth: int = 100, min_emission: float = -5.0, max_gap: int = 50) -> DataFrame:
    def rows(b):
        reads = b.column("read_id")
        work = [*zip(*(lists(b.column(c)) for c in ("means", "level_mean", "level_stdv")), strict=True)]
        some = [i for i, (m, a, _) in enumerate(work) if len(m) and len(a)]
        found = banded_align_many([work[i] for i in some], bandwidth, min_emission, max_gap)
        return by_read(reads, some, [(k, e) for k, e, _ in found])

    return batched(work.select("read_id", "means", "level_mean", "level_stdv"), rows, "read_id long, kmer_idx int, event_idx int")


def segment_reads(signal: DataFrame, mixed_tail: bool = False) -> DataFrame:
    """Regions of each read's scaled samples: last sample of each, and cliffs. With mixed_tail also the last sample of the
    first kind of tail and the first of the second, from the tail's beginning, -1 where there is none."""
    from .signal import BITS, CENTRE

    def row(r):
        if not r["samples"] or len(r["samples"]) <= 3:
            return []
        x = np.array(r["samples"], dtype=float)
        out = {"read_id": r["read_id"]} | regions(segment(x, mixed_tail))
        if mixed_tail:
            tail = x[out["adapter"] + 1 : out["polya"] + 1]
            i, a = -1, -1
            if len(tail) >= 100:
                y = tail - tail.mean() + CENTRE
                y = np.where((y > 200) | (y < 40), 100.0, y)
                i, a = switch((log_normal(y, *BITS["polyi"]) / log_normal(y, *BITS["polya"]) > 1).astype(int))
            out |= {"polyi_end": i, "polya_start": a}
        return [out]

    return mapped(signal, row, "read_id long, start int, leader int, adapter int, polya int, cliffs int" + ", polyi_end int, polya_start int" * mixed_tail)


def align_to_reference(work: DataFrame, stride: int = 100, emit: int = 50) -> DataFrame:
    """Events of long reads along the reference: read_id, event_idx, kmer_idx, state. work: as for align_reads, with anchors
    (array of structs kmer, event), such as the base alignment's pairs give."""

    def rows(b):
        reads, per_base, anchors = b.column("read_id"), b.column("events_per_base").to_pylist(), b.column("anchors").to_pylist()
        levels = [*zip(*(lists(b.column(c)) for c in ("means", "level_mean", "level_stdv")), strict=True)]
        pairs = [[(x["kmer"], x["event"]) for x in p or [] if 0 <= x["kmer"] < len(a) and 0 <= x["event"] < len(m)] for p, (m, a, _) in zip(anchors, levels, strict=True)]
        work = [(*x, p, e) for x, p, e in zip(levels, pairs, per_base, strict=True)]
        return _stated(by_read(reads, [*range(len(work))], align_chained_many(work, stride, emit)))

    return batched(work.select("read_id", "means", "level_mean", "level_stdv", "events_per_base", "anchors"), rows, ALIGNED)
