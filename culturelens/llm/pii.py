r"""Personal data: rules for four kinds, and a character BiLSTM-CRF for what the rules miss.

Base spans are the leftmost non-overlapping matches of each kind that pass its check. The
rules lose data that stands beside other data: a phone number before a card number is one
match of too many digits. The tagger adds such spans. It reads characters in both
directions (two LSTMs), scores nine tags at each (outside; begin and inside of each kind)
and learns the transitions between tags (CRF). It is trained in numpy from labelled spans:
texts of a bounded sample with their base spans, and the same contexts with personal data
written into them, alone, side by side and in other spellings.

WINDOW characters from every STRIDE are scored; a character's tag scores are the mean over
its windows, weighted towards their middles, and one best tag path is decoded over each
whole stretch that windows cover. Only windows that hold a digit or an @ are scored: every
kind needs one, and a window's scores depend on nothing outside it. A decoded span is added if,
without its separators, it passes the check of its kind and overlaps no base span.

Defined cases: null texts are empty; empty ones have no spans; spans of equal start are
ordered by kind as listed; repeated rows are tagged alike; an empty table, or one without
digits and @, needs no model; other columns are ignored. A text is read whole, however
long. The sample is SAMPLE texts by the hash of id and text, one snippet of each.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only; from later digits the same would fail again.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = "[0-9@]"
LOCAL_CHARS = frozenset(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SAMPLE = 1500       # texts that the tagger learns from, at most
SNIPPET = 400       # characters of each
WINDOW, STRIDE = 96, 48
UNITS = 24          # of each direction
EMBEDDED = 12
EPOCHS = 8
BATCH = 32
RATE = 0.01
SEED = 11
TAGS = 1 + 2 * len(KINDS)     # 0 outside, then begin and inside of each kind
SCORED = 512        # windows scored at a time
FORBIDDEN = -1e4

Span = tuple[int, int, int]   # start, end, place of the kind in KINDS


class Found(NamedTuple):
    """Base spans, and the places of matches that failed their check."""

    spans: list[Span]
    failed: list[tuple[int, int]]


# Rules


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good_ip(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def good_card(text: str) -> bool:
    number = digits(text)
    return 12 <= len(number) <= 19 and luhn(number)


def good_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


CHECKED = ((1, IP, good_ip), (2, CARD, good_card), (3, PHONE, good_phone))


def email_spans(text: str) -> list[Span]:
    """Around each @: every start in the run of characters before it would end there alike."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, end, 0))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> Found:
    spans, failed = email_spans(text), []
    for kind, pattern, good in CHECKED:
        for match in pattern.finditer(text):
            if good(match.group()):
                spans.append((*match.span(), kind))
            else:
                failed.append(match.span())
    return Found(sorted(spans, key=lambda s: (s[0], s[2])), failed)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# Labelled spans for training


def _card(rng: random.Random) -> str:
    number = rng.choice("3456") + "".join(rng.choice("0123456789")
                                          for _ in range(rng.choice((13, 14, 14, 14))))
    number += next(c for c in "0123456789" if luhn(number + c))
    gap = rng.choice(("", "", " ", "-"))
    return gap.join(number[i:i + 4] for i in range(0, len(number), 4))


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def _phone(rng: random.Random) -> str:
    a, b, c, d = rng.randrange(1, 99), *(rng.randrange(100, 1000) for _ in range(2)), rng.randrange(
        1000, 10000)
    return rng.choice(("+{} ({}) {}-{}", "+{} {} {} {}", "+{}-{}-{}-{}", "+{}{}{}{}",
                       "+{} {} {}{}", "+{} {}.{}.{}", "({1}) {2}-{3}")).format(a, b, c, d)


def _email(rng: random.Random) -> str:
    def word(least: int, most: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz")
                       for _ in range(rng.randint(least, most)))

    local = word(2, 9) + rng.choice(("", "", ".", "_", "-", "+")) + rng.choice(
        ("", word(2, 7), str(rng.randrange(1000))))
    host = word(3, 9) + rng.choice(("", "", str(rng.randrange(100))))
    domain = rng.choice(("", "", word(3, 7) + ".")) + host + "." + rng.choice(
        ("com", "org", "net", "de", "fr", "es", "info", "co.uk"))
    return local + rng.choice(("@", "@", "@", "@", " @ ", " @")) + domain


WRITERS = (_email, _ip, _card, _phone)


def written_into(context: str, rng: random.Random) -> tuple[str, list[Span]]:
    """The context with one to three items of personal data between its words."""
    at = context.find(" ", rng.randrange(len(context) + 1)) + 1
    out, spans = context[:at], []
    for _ in range(rng.choice((1, 2, 2, 3))):
        kind = rng.randrange(len(KINDS))
        item = WRITERS[kind](rng)
        spans.append((len(out), len(out) + len(item), kind))
        out += item + rng.choice((" ", " ", " ", ", ", "\n"))
    return out + context[at:], spans


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for start, end, kind in spans:
        tags[start] = 1 + 2 * kind
        tags[start + 1:end] = 2 + 2 * kind
    return tags


def symbols(text: str) -> np.ndarray:
    """One of 99 symbols a character: ASCII by itself, others by their class. 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 96)
    out[(codes >= 9) & (codes <= 13)] = 97
    out[codes >= 128] = 98
    return out


VOCABULARY = 99


def labelled_windows(snippets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: every snippet as it is and with data written into it.

    Where a rule's match failed its check the right tags are unknown; such snippets
    serve only without their digits, as contexts.
    """
    rng = random.Random(SEED)
    xs, ys = [], []

    def add(text: str, spans: list[Span], centre: int) -> None:
        start = max(0, min(centre - rng.randrange(WINDOW), len(text) - WINDOW))
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        part = symbols(text[start:start + WINDOW])
        x[:len(part)], y[:len(part)] = part, tags_of(len(text), spans)[start:start + WINDOW]
        xs.append(x)
        ys.append(y)

    for snippet in snippets:
        found = base_spans(snippet)
        if not found.failed:
            first = re.search(TRIGGER, snippet)
            spans = sorted(found.spans, key=lambda s: s[0] - s[1])
            apart = [s for i, s in enumerate(spans)
                     if not any(s[0] < t[1] and t[0] < s[1] for t in spans[:i])]
            add(snippet, apart, first.start() if first else 0)
        text, spans = written_into(re.sub(TRIGGER, "", snippet), rng)
        add(text, spans, spans[0][0] + 20)
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


# The network


def allowed() -> np.ndarray:
    """(TAGS + 1, TAGS): which tag may follow which; the last row starts a text."""
    ok = np.zeros((TAGS + 1, TAGS), bool)
    ok[:, 0] = ok[:, 1::2] = True
    for kind in range(len(KINDS)):
        ok[1 + 2 * kind, 2 + 2 * kind] = ok[2 + 2 * kind, 2 + 2 * kind] = True
    return ok


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def uniform(fan: int, *shape: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) / np.sqrt(fan)

    params = {
        "embed": uniform(EMBEDDED, VOCABULARY, EMBEDDED),
        "wx": uniform(EMBEDDED, 2, EMBEDDED, 4 * UNITS),
        "wh": uniform(UNITS, 2, UNITS, 4 * UNITS),
        "b": np.zeros((2, 1, 4 * UNITS)),
        "wo": uniform(2 * UNITS, 2 * UNITS, TAGS),
        "bo": np.zeros(TAGS),
        "move": np.zeros((TAGS + 1, TAGS)),
    }
    params["b"][:, :, UNITS:2 * UNITS] = 1.0      # forget gates start open
    return params


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def scores(params: dict, x: np.ndarray, held: dict | None = None) -> np.ndarray:
    """(window, place, tag) scores; `held` receives what the gradient needs."""
    n, length = x.shape
    both = np.stack([x, x[:, ::-1]])                       # the second direction reads backwards
    entered = params["embed"][both]                        # 2, n, length, EMBEDDED
    pre = np.einsum("dnle,deg->ldng", entered, params["wx"], optimize=True) + params["b"]
    h = np.zeros((2, n, UNITS), pre.dtype)
    c = np.zeros_like(h)
    hs = np.empty((length + 1, 2, n, UNITS), pre.dtype)
    cs, gates = np.empty_like(hs), np.empty((length, 2, n, 4 * UNITS), pre.dtype)
    hs[0], cs[0] = h, c
    for t in range(length):
        a = pre[t] + h @ params["wh"]
        a[..., :3 * UNITS] = _sigmoid(a[..., :3 * UNITS])
        a[..., 3 * UNITS:] = np.tanh(a[..., 3 * UNITS:])
        i, f, o, g = (a[..., k * UNITS:(k + 1) * UNITS] for k in range(4))
        c = f * c + i * g
        h = o * np.tanh(c)
        hs[t + 1], cs[t + 1], gates[t] = h, c, a
    joined = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2).transpose(1, 0, 2)
    if held is not None:
        held.update(entered=entered, hs=hs, cs=cs, gates=gates, joined=joined, both=both)
    return joined @ params["wo"] + params["bo"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def moves(params: dict) -> np.ndarray:
    return np.where(allowed(), params["move"], FORBIDDEN).astype(params["move"].dtype)


def crf_loss(emitted: np.ndarray, move: np.ndarray, y: np.ndarray, real: np.ndarray):
    """Mean negative log-likelihood of the tags, and its gradients.

    `real` marks characters, which come first; what follows them takes no part.
    """
    n, length, _ = emitted.shape
    inner = move[:-1]
    ahead = np.empty_like(emitted)
    ahead[:, 0] = emitted[:, 0] + move[-1]
    for t in range(1, length):
        step = _log_sum(ahead[:, t - 1, :, None] + inner, 1) + emitted[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    whole = _log_sum(ahead[:, -1], 1)
    back = np.zeros_like(emitted)
    d_move = np.zeros_like(move, dtype=np.float64)
    for t in range(length - 1, 0, -1):
        after = emitted[:, t] + back[:, t]
        step = _log_sum(inner + after[:, None, :], 2)
        keep = real[:, t, None]
        back[:, t - 1] = np.where(keep, step, back[:, t])
        pair = np.exp(ahead[:, t - 1, :, None] + inner + after[:, None, :]
                      - whole[:, None, None])
        d_move[:-1] += (pair * keep[:, :, None]).sum(0)
    share = np.exp(ahead + back - whole[:, None, None]) * real[:, :, None]
    d_move[-1] = share[:, 0].sum(0)
    rows = np.arange(n)[:, None]
    gold = (emitted[rows, np.arange(length), y] * real).sum(1) + move[-1, y[:, 0]]
    gold += (inner[y[:, :-1], y[:, 1:]] * real[:, 1:]).sum(1)
    d_emitted = share
    d_emitted[rows, np.arange(length), y] -= real
    np.add.at(d_move[-1], y[:, 0], -1.0)
    np.add.at(d_move, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), -1.0)
    return float((whole - gold).mean()), d_emitted / n, d_move / n


def loss_and_gradient(params: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    held: dict = {}
    emitted = scores(params, x, held)
    loss, d_emitted, d_move = crf_loss(emitted, moves(params), y, x > 0)
    n, length = x.shape
    grad = {"move": np.where(allowed(), d_move, 0.0), "bo": d_emitted.sum((0, 1)),
            "wo": np.einsum("nlu,nlt->ut", held["joined"], d_emitted, optimize=True)}
    d_joined = (d_emitted @ params["wo"].T).transpose(1, 0, 2)
    d_hs = np.stack([d_joined[:, :, :UNITS], d_joined[::-1, :, UNITS:]], axis=1)
    d_pre = np.empty_like(held["gates"])
    d_h = np.zeros((2, n, UNITS), emitted.dtype)
    d_c = np.zeros_like(d_h)
    back = params["wh"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        a = held["gates"][t]
        i, f, o, g = (a[..., k * UNITS:(k + 1) * UNITS] for k in range(4))
        d_h = d_h + d_hs[t]
        bent = np.tanh(held["cs"][t + 1])
        d_c = d_c + d_h * o * (1 - bent * bent)
        d = d_pre[t]
        d[..., :UNITS] = d_c * g * i * (1 - i)
        d[..., UNITS:2 * UNITS] = d_c * held["cs"][t] * f * (1 - f)
        d[..., 2 * UNITS:3 * UNITS] = d_h * bent * o * (1 - o)
        d[..., 3 * UNITS:] = d_c * i * (1 - g * g)
        d_c = d_c * f
        d_h = d @ back
    grad["b"] = d_pre.sum((0, 2))[:, None, :]
    grad["wh"] = np.einsum("ldnu,ldng->dug", held["hs"][:-1], d_pre, optimize=True)
    grad["wx"] = np.einsum("dnle,ldng->deg", held["entered"], d_pre, optimize=True)
    d_entered = np.einsum("ldng,deg->dnle", d_pre, params["wx"], optimize=True)
    grad["embed"] = np.zeros_like(params["embed"])
    np.add.at(grad["embed"], held["both"], d_entered)
    return loss, grad


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam over shuffled batches with clipped gradients, in single precision."""
    params = {k: v.astype(np.float32) for k, v in initial(seed).items()}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    rng, step = np.random.default_rng(seed), 0
    total = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            _, grad = loss_and_gradient(params, x[rows], y[rows])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - step / (total + 1))
            for k, g in grad.items():
                g = (g * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return params


# Decoding


def best_paths(emitted: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tag path of each stretch; what follows its length stays outside."""
    n, longest, _ = emitted.shape
    best = emitted[:, 0] + move[-1]
    came = np.zeros((longest, n, TAGS), np.int8)
    stay = np.arange(TAGS)
    for t in range(1, longest):
        step = best[:, :, None] + move[:-1]
        real = (t < lengths)[:, None]
        came[t] = np.where(real, step.argmax(1), stay)
        best = np.where(real, step.max(1) + emitted[:, t], best)
    paths = np.zeros((n, longest), np.int8)
    tag = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        paths[:, t] = np.where(t < lengths, tag, 0)
        tag = came[t][np.arange(n), tag]
    return paths


def path_spans(path: np.ndarray) -> list[Span]:
    spans = []
    for start in np.flatnonzero(path % 2 == 1).tolist():
        inside, end = path[start] + 1, start + 1
        while end < len(path) and path[end] == inside:
            end += 1
        spans.append((start, end, int(path[start]) // 2))
    return spans


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    starts: dict[int, None] = {}
    for match in re.finditer(TRIGGER, text):
        at = match.start() // STRIDE * STRIDE
        starts.update(dict.fromkeys(range(max(0, at - WINDOW + STRIDE), at + 1, STRIDE)))
    return list(starts)


WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _stretches(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """Maximal stretches of the text that windows cover."""
    out: list[list[int]] = []
    for s in starts:
        end = min(s + WINDOW, len(text))
        if out and s <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([s, end])
    return [(a, b) for a, b in out]


def tagged(params: dict, texts: list[str]) -> list[list[Span]]:
    """Decoded spans of each text, as the tagger has them."""
    starts = [window_starts(t) for t in texts]
    jobs = [(k, s) for k, some in enumerate(starts) for s in some]
    stretches = [(k, a, b) for k, t in enumerate(texts) for a, b in _stretches(t, starts[k])]
    sums = {(k, a): np.zeros((b - a, TAGS + 1), np.float32) for k, a, b in stretches}
    owner: dict[tuple[int, int], int] = {}
    for k, a, b in stretches:
        for s in range(a, b, STRIDE):
            owner[k, s] = a
    for i in range(0, len(jobs), SCORED):
        some = jobs[i:i + SCORED]
        x = np.zeros((len(some), WINDOW), np.int64)
        for row, (k, s) in zip(x, some):
            part = symbols(texts[k][s:s + WINDOW])
            row[:len(part)] = part
        for (k, s), e in zip(some, scores(params, x)):
            a = owner[k, s]
            into = sums[k, a][s - a:s - a + WINDOW]
            into[:, :TAGS] += e[:len(into)] * WEIGHT[:len(into), None]
            into[:, TAGS] += WEIGHT[:len(into)]
    found: list[list[Span]] = [[] for _ in texts]
    move = moves(params).astype(np.float32)
    order = sorted(stretches, key=lambda s: s[2] - s[1])
    while order:
        # stretches of similar length together, and not too many scores at a time
        longest = order[-1][2] - order[-1][1]
        many = max(1, min(256, 200_000 // longest))
        some, order = order[-many:], order[:-many]
        emitted = np.zeros((len(some), longest, TAGS), np.float32)
        for row, (k, a, b) in zip(emitted, some):
            mean = sums.pop((k, a))
            row[:b - a] = mean[:, :TAGS] / mean[:, TAGS:]
        lengths = np.array([b - a for _, a, b in some])
        for path, (k, a, b) in zip(best_paths(emitted, lengths, move), some):
            found[k] += [(a + s, a + e, kind) for s, e, kind in path_spans(path[:b - a])]
    return found


FULL_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
FULL_IP = re.compile(r"[0-9]+(\.[0-9]+){3}")
FULL_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
FULL_PHONE = re.compile(r"(\+[0-9]|\([0-9])[ ().0-9-]+[0-9]")


def proper(text: str, kind: int) -> bool:
    """Whether a decoded span is what its kind asks for."""
    if kind == 0:
        return bool(FULL_EMAIL.fullmatch(text.replace(" ", "")))
    if kind == 1:
        return bool(FULL_IP.fullmatch(text)) and good_ip(text)
    if kind == 2:
        return bool(FULL_CARD.fullmatch(text)) and good_card(text)
    return bool(FULL_PHONE.fullmatch(text)) and good_phone(text)


def with_added(text: str, base: list[Span], decoded: list[Span]) -> list[Span]:
    """Base spans and the proper decoded ones that overlap none of them."""
    taken = sorted((s, e) for s, e, _ in base)
    firsts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else firsts
    out = list(base)
    for start, end, kind in decoded:
        before = int(np.searchsorted(firsts, end)) - 1      # the last base span that starts ahead
        if before >= 0 and reach[before] > start:
            continue
        # whole numbers only: digits beside the span would belong to it
        beside = text[max(0, start - 1):start] + text[end:end + 1]
        if not digits(beside) and proper(text[start:end], kind):
            out.append((start, end, kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def fit(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> dict | None:
    """The tagger, from snippets around the first digit or @ of `sample` texts."""
    text = F.col(text_col).cast("string")
    ahead = F.length(F.regexp_extract(text, "^[^0-9@]*", 0))
    held = docs.where(text.rlike(TRIGGER)).withColumn(
        "_h", F.xxhash64(F.col(id_col).cast("string"), text))
    # About twice the sample by the hash, so that tasks send few rows, then the first of these.
    share = min(1.0, 2 * sample / max(held.count(), 1))
    rows = held.where(F.shiftrightunsigned("_h", 11) <= int(share * 2**53)).select(
        F.shiftrightunsigned("_h", 11).alias("h"),
        F.substring(text, F.greatest(ahead - SNIPPET // 2, F.lit(0)) + 1,
                    F.lit(SNIPPET)).alias("snippet"),
    ).orderBy("h", "snippet").limit(sample).collect()
    return train(*labelled_windows([r.snippet for r in rows])) if rows else None


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       sample: int = SAMPLE) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    params = fit(docs, id_col, text_col, sample)
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long,"
              " base_sha256 string, spans string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = re.compile(TRIGGER).search
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out = [[0, 0, 0, 0, nothing, ""] for _ in range(batch.num_rows)]
            rows, texts = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text and search(text):
                    rows.append(row)
                    texts.append(text)
            for at in range(0, len(texts), 64):
                some = texts[at:at + 64]
                for row, text, decoded in zip(rows[at:], some, tagged(params, some)):
                    base = base_spans(text).spans
                    counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                    out[row] = [*counts, hashlib.sha256(listed(base).encode()).hexdigest(),
                                listed(with_added(text, base, decoded))]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = [part.split()[0] for part in schema.split(", ")]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, schema)
