"""Personal data: exact patterns, and a character-level BiLSTM with CRF transitions for other spellings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

KINDS = ("email", "ip", "card", "phone")
#: The tagger's tags: outside, then first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Windows begin every ZONE characters, MARGIN before a zone, and reach MARGIN beyond its end, so that they overlap by half.
ZONE, MARGIN = 48, 24
WINDOW = ZONE + 2 * MARGIN
HIDDEN, STEPS, BATCH, RATE = 20, 420, 48, 0.02

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# leading digits can't be given back, and a match can't begin inside a run of digits: both only save time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What every span holds at least one of, in any spelling; zones without, and not next to one, can't hold any.
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]|\sdot\s", re.IGNORECASE)
#: A character that no span holds.
_BREAK = 10


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns: per kind leftmost, non-overlapping, failing ones dropped."""
    found = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        # matches end before the next "@", so a local part starts where its run does or where the last match ended
        start = done
        if at - 1 >= done:
            run = at
            while run > done and (text[run - 1].isascii() and (text[run - 1].isalnum() or text[run - 1] in "._%+-")):
                run -= 1
            start = run
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at += 1
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in ((2, _CARD, 16, 19), (3, _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return found


# --- training data: lines of invented words with labelled spans -------------------------------------------------


def _word(r: np.random.Generator) -> str:
    letters = "etaoinshrdlucmfwypvbgkqjxzéèüñóßç"
    return "".join(letters[int(len(letters) * x**1.7)] for x in r.random(r.integers(1, 11)))


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _sample(r: np.random.Generator) -> tuple[int | None, str]:
    """A span with its kind, or something like one with none."""
    d, pick = (lambda n: _digits(r, n)), (lambda *x: x[r.integers(len(x))])
    kind = int(r.integers(0, 8))
    if kind == 0:
        name = re.sub("[^a-z]", "", _word(r) + _word(r)) + pick("", "", "." + d(2), "_" + d(1), d(3), "." + re.sub("[^a-z]", "", _word(r) + "e"))
        host, end = re.sub("[^a-z]", "", _word(r)) + "x" + pick("", d(1), "-" + d(1)), pick("com", "org", "net", "example.com", "de", "fr", "co.uk", "io")
        at, dot = pick("@", "@", " (at) ", " [at] ", "(at)", " {at} ", " at "), pick(".", ".", " (dot) ", " [dot] ", "[dot]", " dot ")
        if at == " at ":
            dot = " dot "
        at, dot = (pick(x, x, x.upper(), "".join(c.upper() if r.random() < 0.5 else c for c in x)) for x in (at, dot))
        if at != "@":
            name = name.replace(".", dot)
        whole = (name or "a") + at + (host + "." + end).replace(".", dot)
        return 0, whole.upper() if r.random() < 0.15 else whole
    if kind == 1:
        return 1, pick(".", ".", "[.]", " . ").join(str(x) for x in r.integers(1, 256, 4))
    if kind == 2:
        sep = pick("", " ", "-", ".", "  ")
        return 2, sep.join(d(4) for _ in range(4))
    if kind == 3:
        a, b, c = d(3), d(3), d(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {d(4)} {d(6)}", f"+{d(2)}-{a}-{b}-{c}", f"00{d(2)} {a} {b} {c}", f"({a}){b}-{c}", f"{a} {b} {c}")
    y = f"{r.integers(1900, 2030)}"
    return None, pick(
        y, d(1), d(2), d(5), f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{y}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"#{d(6)}", f"${d(2)},{d(3)}.{d(2)}", f"@{_word(r)}", f"{d(1)}%", d(22), f"v{d(1)}.{d(2)}",
        f'token = "{"".join(f"{x:x}" for x in r.integers(0, 16, 40))}"', f"password={''.join(f'{x:x}' for x in r.integers(0, 16, 18))}", "AKIA" + "".join(chr(65 + x) for x in r.integers(0, 26, 9)) + d(3) + "XQ",
        f"{d(2)}/{d(2)}/{y}", f"{y}-{y}", f"{d(3)} {d(3)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{_word(r)} at {_word(r)}", f"{_word(r)} dot {_word(r)}", f"({d(1)})", f"{d(3)}-{d(3)}", f"Apache License {d(1)}.0", f"https://{_word(r)}.com/{d(4)}",
    )


#: Windows that are cut from one generated line.
CUTS = 6


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of characters and tags, cut at random places of lines with labelled spans."""
    r = np.random.default_rng(seed)
    x, y = np.zeros((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int8)
    line, marks = np.empty(0, np.int16), np.empty(0, np.int8)
    for k in range(n):
        if k % CUTS == 0:
            text, tags = "", []
            while len(text) < 4 * WINDOW:
                if r.random() < 0.3:
                    kind, s = _sample(r)
                    marked = [0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
                else:
                    s = _word(r)
                    s = s.capitalize() if r.random() < 0.15 else s
                    marked = [0] * len(s)
                end = ("", ",", ".", ":", ";", "\n", ")", "!")[r.integers(8)] if r.random() < 0.35 else ""
                if end and len(s) and marked[-1] and end in ".)":
                    end = ""
                text += s + end + " "
                tags += marked + [0] * (len(end) + 1)
            line, marks = codes(text), np.array(tags, np.int8)
        at = r.integers(0, len(line) - WINDOW)
        x[k], y[k] = line[at : at + WINDOW], marks[at : at + WINDOW]
        if r.random() < 0.15:  # the end of a text
            cut = r.integers(MARGIN, WINDOW)
            x[k, cut:], y[k, cut:] = 0, 0
    return x, y


def codes(text: str) -> np.ndarray:
    """0 is no character, 1 to 127 ASCII, 128 other letters, 129 anything else."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, np.maximum(cp, 1), np.where(cp < 0x2000, 128, 129)).astype(np.int16)


# --- the tagger -------------------------------------------------------------------------------------------------

CHARS = 130


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _both(p: dict, name: str) -> np.ndarray:
    return np.stack([p[name + "F"], p[name + "B"]])


def _lstm(p: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    """x: [T, N] characters, read forwards and backwards side by side. The states [T, 2, N, H], each way in its own order,
    and what the gradient needs."""
    rec, bias = _both(p, "rec"), _both(p, "bias")[:, None]
    h = c = np.zeros((2, x.shape[1], HIDDEN), np.float32)
    out, kept = np.empty((len(x), 2, x.shape[1], HIDDEN), np.float32), []
    for t in range(len(x)):
        z = h @ rec
        z[0] += p["inF"][x[t]]
        z[1] += p["inB"][x[-1 - t]]
        z += bias
        gates = _sigmoid(z[:, :, : 3 * HIDDEN])
        i, f, o, g = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN], gates[:, :, 2 * HIDDEN :], np.tanh(z[:, :, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        kept.append((h, before, gates, g, tc))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_gradient(p: dict, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
    """dout: [T, 2, N, H] as _lstm gives its states."""
    rec = _both(p, "rec")
    back, total = np.ascontiguousarray(rec.transpose(0, 2, 1)), np.zeros_like(rec)
    dh = dc = np.zeros((2, x.shape[1], HIDDEN), np.float32)
    dz = np.empty((len(x), 2, x.shape[1], 4 * HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, before, gates, g, tc = kept[t]
        i, f, o = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN], gates[:, :, 2 * HIDDEN :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        slope = gates * (1 - gates)
        z = dz[t]
        z[:, :, :HIDDEN] = dc * g
        z[:, :, HIDDEN : 2 * HIDDEN] = dc * before
        z[:, :, 2 * HIDDEN : 3 * HIDDEN] = dh * tc
        z[:, :, : 3 * HIDDEN] *= slope
        z[:, :, 3 * HIDDEN :] = dc * i * (1 - g * g)
        total += h.transpose(0, 2, 1) @ z
        dh, dc = z @ back, dc * f
    for k, (way, read) in enumerate((("F", x), ("B", x[::-1]))):
        grad["rec" + way] += total[k]
        grad["bias" + way] += dz[:, k].sum((0, 1))
        flat = read.ravel()
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        grad["in" + way][seen] += np.add.reduceat(dz[:, k].reshape(len(flat), -1)[order], first)


def _emissions(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    out, kept = _lstm(p, x)
    states = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
    return states @ p["out"] + p["outbias"], (states, kept)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(p: dict, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of tags y [T, N] under emissions e, with its gradient by e and by the transitions."""
    trans, (steps, n, k) = p["trans"], e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    dtrans = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    at_t, at_n = np.arange(steps)[:, None], np.arange(n)[None]
    score = e[at_t, at_n, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    de[at_t, at_n, y] -= 1
    np.add.at(dtrans, (y[:-1], y[1:]), -1)
    return float((z - score).mean()), de / n, dtrans / n


@lru_cache(2)
def trained(seed: int = 7, steps: int = STEPS) -> dict:
    """The tagger's weights: Adam on the CRF likelihood of generated windows. The same for every corpus."""
    r = np.random.default_rng(seed)
    p = {"out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "outbias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for way in "FB":
        p |= {"in" + way: r.normal(0, 0.3, (CHARS, 4 * HIDDEN)), "rec" + way: r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "bias" + way: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    x_all, y_all = training_windows(9000, seed + 1)
    for step in range(1, steps + 1):
        some = r.integers(0, len(x_all), BATCH)
        x, y = x_all[some].T.astype(int), y_all[some].T.astype(int)
        e, (states, kept) = _emissions(p, x)
        _, de, dtrans = _crf(p, e, y)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["trans"] += dtrans
        grad["out"] += np.tensordot(states, de, ((0, 1), (0, 1)))
        grad["outbias"] += de.sum((0, 1))
        ds = (de @ p["out"].T).astype(np.float32)
        _lstm_gradient(p, x, kept, np.stack([ds[:, :, :HIDDEN], ds[::-1, :, HIDDEN:]], axis=1), grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def best_tags(trans: np.ndarray, e: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best tags of e [position, tag]: in each stretch e[begin:begin + size] the path with the largest sum of
    emissions and transitions, from and to the outside tag; 0 elsewhere."""
    tags = np.zeros(len(e), np.int8)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    if not len(size) or not size[0]:
        return tags
    active = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1), "left")
    score, back = trans[0] + e[begin[: active[0]]], np.zeros(e.shape, np.int8)
    for t in range(1, size[0]):
        k = active[t]
        through = score[:k, :, None] + trans
        back[begin[:k] + t] = through.argmax(1)
        score[:k] = through.max(1) + e[begin[:k] + t]
    last = (score + trans[:, 0]).argmax(1)
    for t in range(size[0] - 1, -1, -1):
        at = begin[: active[t]] + t
        tags[at] = last[: active[t]]
        last[: active[t]] = back[at, last[: active[t]]]
    return tags


_PARTS = re.compile(r"[0-9]+")


def _valid(kind: int, s: str) -> bool:
    """Whether a span of the tagger has what its kind needs."""
    if "\n" in s:
        return False
    groups = _PARTS.findall(s)
    digits = sum(map(len, groups))
    if kind == 0:
        low = s.lower()
        return bool(re.search(r"[a-z0-9].*(@|[(\[{]\s?at\s?[)\]}]|\sat\s).*[a-z0-9].*(\.|dot).*[a-z]{2}", low)) and low.count(" ") <= 6
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not re.search(r"[A-Za-z]", s)
    if re.search(r"[^0-9 ().+\-]", s):
        return False
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(groups))
    return 9 <= digits <= 15 and len(groups) >= 3


def _zones(text: str) -> list[int]:
    """Zones of the text that may hold a part of a span."""
    near: set[int] = set()
    for m in _TRIGGER.finditer(text):
        near |= {*range(m.start() // ZONE - 1, (m.end() - 1) // ZONE + 2)}
    last = (len(text) - 1) // ZONE
    return sorted(z for z in near if 0 <= z <= last)


#: How much a window counts for each of its characters: most in its middle, whose surroundings it sees.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def reconciled(e: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Emissions [zone, ZONE, tag] from those of windows [zone, WINDOW, tag]: the weighted mean of all windows that see
    a character. joined: whether a zone follows the one before it in its text."""
    e = e * _WEIGHT
    middle = slice(MARGIN, MARGIN + ZONE)
    out, weight = e[:, middle].copy(), np.repeat(_WEIGHT[None, middle], len(e), axis=0)
    k = np.flatnonzero(joined)
    for to, of, here, there in ((k, k - 1, slice(0, MARGIN), slice(MARGIN + ZONE, WINDOW)), (k - 1, k, slice(ZONE - MARGIN, ZONE), slice(0, MARGIN))):
        out[to, here] += e[of, there]
        weight[to, here] += _WEIGHT[there]
    return out / weight


#: Zones decoded together, about, and characters from which a text is read in parts that end with lines.
TOGETHER, PART = 2048, 1 << 20


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text: whole, or for a long one parts that end with the first line end after PART characters."""
    at = 0
    while len(text) - at > PART and (end := text.find("\n", at + PART)) >= 0:
        yield at, text[at : end + 1]
        at = end + 1
    yield at, text[at:] if at else text


def model_spans(p: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the tagger finds in each text. What overlapping windows say of a character is averaged,
    and one Viterbi pass over all of a text's zones in a row, between line ends, which no span crosses, sets the tags."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = [(k, at, part) for k, text in enumerate(texts) for at, part in _parts(text)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    some: list[tuple[int, int]] = []
    for n, (_, _, part) in enumerate(parts):
        for z in _zones(part):
            if len(some) >= TOGETHER and some[-1] != (n, z - 1):  # a gap, so nothing goes on
                _decode(p, [x for _, _, x in parts], some, found)
                some = []
            some.append((n, z))
    if some:
        _decode(p, [x for _, _, x in parts], some, found)
    for (k, at, _), spans in zip(parts, found, strict=True):
        out[k] += [(kind, a + at, b + at) for kind, a, b in spans]
    return out


def _decode(p: dict, texts: list[str], where: list[tuple[int, int]], out: list[list[tuple[int, int, int]]]) -> None:
    e = np.empty((len(where), WINDOW, TAGS), np.float32)
    x = np.zeros((len(where), WINDOW), np.int16)
    for row, (k, z) in zip(x, where, strict=True):
        lo = z * ZONE - MARGIN
        c = codes(texts[k][max(lo, 0) : lo + WINDOW])
        row[max(-lo, 0) : max(-lo, 0) + len(c)] = c
    for i in range(0, len(where), 2048):
        e[i : i + 2048] = _emissions(p, x[i : i + 2048].T.astype(int))[0].transpose(1, 0, 2)
    doc, zone = np.array(where).T
    joined = np.append(False, (doc[1:] == doc[:-1]) & (zone[1:] == zone[:-1] + 1))
    e = reconciled(e, joined).reshape(-1, TAGS)
    char = x[:, MARGIN : MARGIN + ZONE].ravel()
    inside = (char != 0) & (char != _BREAK)
    head = inside & ~np.append(False, inside[:-1]) | inside & (np.repeat(~joined, ZONE) & (np.arange(len(char)) % ZONE == 0))
    begin = np.flatnonzero(head)
    ends = np.flatnonzero(np.append(~inside | head, True))
    size = ends[np.searchsorted(ends, begin, "right")] - begin
    tags = best_tags(p["trans"], e, begin, size)
    first = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | head | (np.append(0, tags[:-1]) != tags) & (np.append(0, tags[:-1]) != tags - 1)))
    stretch = begin[np.searchsorted(begin, first, "right") - 1] + size[np.searchsorted(begin, first, "right") - 1]
    for s, stop in zip(first.tolist(), stretch.tolist(), strict=True):
        kind = (int(tags[s]) - 1) // 2
        end = s + 1
        while end < stop and tags[end] == 2 + 2 * kind:
            end += 1
        k, z = where[s // ZONE]
        text = texts[k]
        a = z * ZONE + s % ZONE
        b = min(a + end - s, len(text))
        while a < b and text[a] in " \t\n,;:.!?)\"'":
            a += 1
        while a < b and text[b - 1] in " \t\n,;:.!?(\"'-":
            b -= 1
        if a < b and _valid(kind, text[a:b]):
            out[k].append((kind, a, b))


def all_spans(p: dict, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """Spans of each text by kind, then start, with whether an exact pattern found them. The tagger's spans
    count where they touch no exact one."""
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    for k, extra in enumerate(model_spans(p, texts)):
        base = base_spans(texts[k])
        new = [x for x in extra if all(x[2] <= b[1] or b[2] <= x[1] for b in base)] if len(base) * len(extra) < 10_000 else _apart(base, extra)
        found[k] = sorted([(*b, True) for b in base] + [(*x, False) for x in new])
    return found


def _apart(base: list[tuple[int, int, int]], extra: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    taken = np.zeros(max([b[2] for b in base] + [x[2] for x in extra]), bool)
    for _, s, e in base:
        taken[s:e] = True
    return [x for x in extra if not taken[x[1] : x[2]].any()]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, exact>>) for every row, by kind (0 email, 1 ip, 2 card,
    3 phone), then start; code points, end exclusive. Null and empty texts have no spans. Whole texts are
    read; zones without a digit, an at sign or its spelling, and not next to such a zone, hold no span by
    definition and aren't decoded. Repeated rows come out as often as they came in."""
    weights = trained()
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = all_spans(weights, [t or "" for t in b.column(1).to_pylist()])
            rows = [[dict(zip(("kind", "start", "end", "exact"), s, strict=True)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int,exact:boolean>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by [EMAIL], [IP], [CARD] or [PHONE]; where spans overlap the
    one that begins first, then the longer one, gives the name and all of it goes. Null texts stay null."""
    weights = trained()
    bounded(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        for k, spans in enumerate(all_spans(weights, [t or "" for t in out])):
            if not spans:
                continue
            text, parts, done = out[k], [], 0
            for s, e, kind in sorted(((s, e, kind) for kind, s, e, _ in spans), key=lambda x: (x[0], -x[1])):
                if s >= done:
                    parts += [text[done:s], f"[{KINDS[kind].upper()}]"]
                done = max(done, e)
            out[k] = "".join([*parts, text[done:]])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
