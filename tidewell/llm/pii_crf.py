"""Personal data by fixed patterns and a linear-chain conditional random field over word-shape features.

:func:`find` gives every document its base spans (e-mail, ip, card and phone patterns with their checks, counted per
kind) and all spans, to which the field adds those it finds beside the base ones: numbers and addresses written in other
ways. Offsets are in code points, ends exclusive. :func:`masked` replaces every span by its kind in brackets.

The field is trained from a small labelled table (:func:`labelled` rows made from templates and :func:`sentences` written
by hand, or one's own rows) by maximum likelihood. Tokens are runs of non-white characters. It is decoded by Viterbi in batches of stretches: a token far from
any with a digit, an at sign or a cue word has only plain word shapes, for which :func:`fit` checks that the best path is
"outside", so such text is skipped without changing the result. Null texts count as empty and have no spans; repeated
rows are each searched; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import bounded


KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
# The patterns of the four kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_CUE = re.compile(r"[0-9@\[({]")
_SPELT = re.compile(r"[\[({](?:at|dot|AT|DOT)[\])}]")
_APART = re.compile(r"[0-9]{1,3}(?:(?:[\[({](?:\.|dot)[\])}])[0-9]{1,3}){3}")
_TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches that pass their checks, each kind by itself.

    E-mails are found from their at signs, each of which has its own run of local characters to the left, so that long
    runs cost linear time."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m and at >= done:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), 0))
                done = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def shape(token: str) -> str:
    """Word shape: runs of letters as a or A, of digits as their number (9 and more as 9), signs as they are, runs folded."""
    t = re.sub(r"[0-9]+", lambda m: "\0" * min(9, len(m[0])), token)
    t = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", t)
    t = re.sub(r"\0+", lambda m: str(len(m[0])), t)
    return re.sub(r"([^\w\s])\1+", r"\1", t)


def features(token: str) -> list[str]:
    """Names of a token's own features."""
    core = token.strip(_TRIM)
    s, digits = shape(core), len(_DIGIT.findall(core))
    low = core.lower()
    found = [f"shape={s}", f"digits={min(digits, 20)}"]
    if "@" in core[1:-1]:
        found += ["at sign", f"dots after at={min(core.rpartition('@')[2].count('.'), 2)}"]
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 for p in parts):
        found.append("four numbers" if all(int(p) <= 255 for p in parts) else "four large numbers")
    if digits and re.fullmatch(r"[0-9() .+-]+", core):
        found += ["number signs", f"groups={min(len(re.findall('[0-9]+', core)), 5)}"]
    spelt = len(_SPELT.findall(token))
    if _SPELT.match(token):
        found.append(f"spelt {low}")
    elif spelt:
        found.append(f"spelt inside={min(spelt, 3)}")
    if _APART.fullmatch(core):
        found.append("four numbers apart")
    if low in ("tel", "phone", "call", "fax", "card", "ip", "mail", "email", "e-mail", "host", "mobile"):
        found.append(f"cue={low}")
    if token.startswith("+") or token.startswith("("):
        found.append(f"opens {token[0]}")
    if digits == 0 and "@" not in core and not spelt:
        found.append("plain")
    return found


def labelled(rows: int = 300, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: token and tag sequences made from templates, with look-alikes that are no personal data."""
    rng = np.random.default_rng(seed)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeioutnrsl"), int(rng.integers(2, 9))))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def card() -> str:
        d = pick("4", "5") + n(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    four = lambda c: [c[i : i + 4] for i in range(0, 16, 4)]
    kinds = [
        lambda: ("email", [f"{word()}.{n(2)}@{word()}.{word()}.com"]),
        lambda: ("email", [f"{word()}@{word()}.org"]),
        lambda: ("email", [word() + pick("", n(2)), pick("[at]", "(at)"), word(), pick("[dot]", "(dot)"), pick("com", "org", "net")]),
        lambda: ("ip", [".".join(str(int(rng.integers(1, 256))) for _ in range(4))]),
        lambda: ("card", [card()]),
        lambda: ("card", four(card())),
        lambda: ("card", ["-".join(four(card()))]),
        lambda: ("phone", [f"+{n(1)}", f"({n(3)})", f"{n(3)}-{n(4)}"]),
        lambda: ("phone", [f"({n(3)})", f"{n(3)}-{n(4)}"]),
        lambda: ("phone", [f"{n(3)}-{n(3)}-{n(4)}"]),
        lambda: ("phone", [f"+{n(2)}{n(9)}"]),
        lambda: ("phone", [f"{n(3)}.{n(3)}.{n(4)}"]),
        lambda: ("phone", pick(["0" + n(3), n(3), n(4)], ["0" + n(2), n(4), n(4)], ["0" + n(1), n(2), n(2), n(2), n(2)], ["0" + n(3), n(3), n(2), n(3)], ["00" + n(2), n(3), n(3), n(4)])),
        lambda: ("email", [word() + pick("[at]", "(at)", "{at}") + word() + pick("[dot]", "(dot)", "{dot}") + pick("com", "org", "net")]),
        lambda: ("ip", [pick("[.]", "(.)", "[dot]", "(dot)").join(str(int(rng.integers(1, 256))) for _ in range(4))]),
        lambda: ("card", [pick(".", "/").join(four(card()))]),
    ]
    none = [
        lambda: [n(4)],
        lambda: [f"{n(1)}.{n(1)}."],
        lambda: [f"{n(1)}.{n(1)}.{n(1)}"],
        lambda: [f"{n(4)}-{n(2)}-{n(2)}"],
        lambda: [f"password={word()}{n(6)}d{n(3)}"],
        lambda: [f"AKIA{n(4)}XQ{n(3)}"],
        lambda: ["token", "=", f'"{n(3)}a{n(9)}c{n(8)}"'],
        lambda: [n(int(rng.integers(1, 9)))],
        lambda: [n(int(rng.integers(17, 30)))],
        lambda: [f"${n(2)}.{n(2)}"],
        lambda: [f"{n(2)}:{n(2)}"],
        lambda: [f"{n(2)}%"],
        lambda: [n(3), n(3)],
        lambda: [pick("1", "2", "3") + n(2), n(3), n(3)],
        lambda: [n(4), n(4), n(4)],
        lambda: [".".join(str(int(rng.integers(300, 999))) for _ in range(4))],
        lambda: ["at", word(), "dot"],
        lambda: ["(" + n(1) + ")"],
        lambda: [f"({n(4)})"],
        lambda: [f"@{word()}"],
        lambda: [f"{word()}{n(2)}"],
    ]
    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(1, 6))):
                tokens.append(pick(str, str, str.title)(word()) + pick("", "", "", ",", "."))
                tags.append("O")
            if rng.random() < 0.5:
                kind, made = pick(*kinds)()
                tags += [("B-" if i == 0 else "I-") + kind for i in range(len(made))]
                made[-1] += pick("", "", "", ".", ",")
            else:
                made = pick(*none)()
                tags += ["O"] * len(made)
            tokens += made
        table.append((tokens, tags))
    return table


# The written part of the labelled table: personal data and look-alikes as people write them, spans in angle brackets.
SENTENCES = """
Please call <phone>(212) 555-0147</phone> after lunch.
Tel. <phone>020 7946 0018</phone> or write to <email>anna [at] garden [dot] org</email> today
Mobile: <phone>07700 900 123</phone>, office <phone>0161 496 0321</phone>
Fax <phone>1-800-555-0199</phone> ext. 12
phone=<phone>555-867-5309</phone>; room=214
Our hotline <phone>800.555.0110</phone> is open from 9:00 to 17:30
Rufen Sie uns an: <phone>030 901820 44</phone> oder schreiben Sie an <email>info(at)haus(dot)de</email>
Telefon <phone>0049 89 636 48018</phone> Durchwahl 5
Handy <phone>0176 1234 5678</phone> ab 18 Uhr
Llame al <phone>912 345 678 90</phone> antes del 15.06.2021
Teléfono: <phone>(55) 5093 4000</phone> ext 3
Appelez le <phone>01 42 68 53 00</phone> ou le <phone>06 12 34 56 78</phone> avant 20h
Contact <email>j.doe (at) example (dot) com</email> for 25 tickets
mail <email>sales[at]shop[dot]net</email> with order 4471
Reach me: <email>kim {at} lab {dot} edu</email> or <phone>415-555-0132</phone>
E-Mail <email>meier [at] firma [dot] de</email> Zimmer 12
correo <email>ventas (at) tienda (dot) es</email> pedido 998
courriel <email>paul[at]asso[dot]fr</email> bureau 3
Card <card>4111.1111.1111.1111</card> expires 09/27
Visa: <card>4012.8888.8888.1881</card> CVV 123
pay with <card>5555/5555/5555/4444</card> now
Karte <card>4000.0566.5566.5556</card> gültig bis 11/26
tarjeta <card>5105.1051.0510.5100</card> de 2019
carte <card>4242/4242/4242/4242</card> svp
blocked host <ip>10[.]0[.]14[.]7</ip> on port 443
traffic from <ip>192[.]168[.]1[.]20</ip> and <ip>172[.]16[.]254[.]1</ip> was dropped
beacon to <ip>203(.)0(.)113(.)9</ip> every 60 seconds
Server <ip>198[dot]51[dot]100[dot]23</ip> meldet Fehler 500
ip: <ip>8[.]8[.]4[.]4</ip> ttl 64
Order number 4471-2291-8 shipped on 12/05/2021 with 3 items
ISBN 978-3-16-148410-0 costs 24.99 in stores
Invoice 2021-000123 totals $1,249.00 due in 30 days
Version 10.4.12.8831 fixes issue 20417 in build 2021.03.15
The score was 21-19, 18-21, 21-15 after 75 minutes
Meet at 10:30 in room 204 on 2021-07-04 or 05.07.2021
Latitude 48.8566, longitude 2.3522, height 35 m
Population grew from 1 204 500 to 1 310 220 in 10 years
Chapter 3 (see pages 114-129) lists 48 tables
Tracking code 1Z 999 AA1 0123 4567 84 arrives in 2 days
Part 555-1234 replaces part 555-1233
Call number QA76.73 .J38 2009 on shelf 12
In 1999 and 2004 (not 2008) sales hit 1.2 million units
Take 2 tablets of 500 mg at 8 and 20 hours
ratio [1.5] and interval (0.25, 0.75) with n = 1200
array[0] and list(3) have length 10
footnote [12] and [13] cite (2) works
see section (a) and (b) of act 1998
Die Rechnung 88123 vom 3.4.2020 über 1.250,00 Euro
Am 24.12. um 18:00 Uhr kamen 250 Gäste
La factura 5521 del 03/04/2020 por 1.250,00 euros
Le train 6607 part à 17h42 voie 12
Serial 4938 2716 0011 of model 730 was recalled
id 1234567890123456 has checksum 77
hash 0123 4567 89ab cdef is wrong
Size 100x200x300 mm, weight 12.5 kg
at 5 dot 3 it says: at home, dot by dot
user@ and @home are no addresses 12
Mix 3 cups (at room heat) with [dot] marks 4
Steps: 1. open, 2. close, 3. wait 10 s
Ports 80, 443, 8080 and 5432 are open
""".strip().splitlines()


def sentences() -> list[tuple[list[str], list[str]]]:
    """The written sentences as token and tag sequences; a token belongs to a span that begins in it or reaches into it."""
    table = []
    for line in SENTENCES:
        text, spans = "", []
        for before, kind, part, rest in re.findall(r"([^<]*)(?:<(\w+)>(.*?)</\2>)?()", line):
            text += before
            if kind:
                spans.append((len(text), len(text) + len(part), kind))
                text += part
        tokens, tags, last = [], [], None
        for m in _TOKEN.finditer(text):
            own = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
            tokens.append(m[0])
            tags.append("O" if own is None else f"{'I' if own == last else 'B'}-{own[2]}")
            last = own
        table.append((tokens, tags))
    return table


@dataclass
class Field:
    known: dict[str, int]
    weights: np.ndarray  # (3, features, tags): of the token, the one before, the one after
    moves: np.ndarray  # (tags, tags)
    first: np.ndarray

    def ids(self, token: str) -> list[int]:
        return [self.known[f] for f in features(token) if f in self.known]

    def emissions(self, tokens: list[str], cache: dict[str, list[int]]) -> np.ndarray:
        own = np.zeros((3, len(tokens), len(TAGS)))
        for i, t in enumerate(tokens):
            at = cache.get(t)
            if at is None:
                at = cache[t] = self.ids(t)
            own[:, i] = self.weights[:, at].sum(axis=1)
        e = own[0]
        e[1:] += own[1, :-1]
        e[:-1] += own[2, 1:]
        return e


def viterbi(emissions: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Best tags of a padded batch (sequences, tokens, tags). Padding carries the last tag on at no cost."""
    b, n, k = emissions.shape
    best, back = field.first + emissions[:, 0], np.zeros((b, n, k), np.int8)
    for t in range(1, n):
        step = best[:, :, None] + field.moves
        came = step.argmax(axis=1)
        live = (t < lengths)[:, None]
        back[:, t] = np.where(live, came, np.arange(k))
        best = np.where(live, np.take_along_axis(step, came[:, None], 1)[:, 0] + emissions[:, t], best)
    path = np.zeros((b, n), np.int8)
    path[:, -1] = best.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t][:, None].astype(np.int64), 1)[:, 0]
    return path


def fit(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum-likelihood weights by Adam, with expectations from forward and backward passes over the padded table."""
    table = table or labelled() + sentences()
    names = sorted({f for tokens, _ in table for t in tokens for f in features(t)})
    known = {f: i for i, f in enumerate(names)}
    k, n = len(TAGS), max(len(t) for t, _ in table)
    field = Field(known, np.zeros((3, len(names), k)), np.zeros((k, k)), np.zeros(k))
    gold = np.full((len(table), n), -1)
    lengths = np.array([len(t) for t, _ in table])
    own = [[field.ids(t) for t in tokens] for tokens, _ in table]
    width = max(len(at) for row in own for at in row)
    ids = np.full((len(table), n + 2, width), len(names))  # feature numbers, padded with one that has no weight; nothing before and after
    for i, row in enumerate(own):
        gold[i, : len(row)] = [TAGS.index(y) for y in table[i][1]]
        for j, at in enumerate(row):
            ids[i, j + 1, : len(at)] = at
    live = np.arange(n)[None, :] < lengths[:, None]
    # for each token: its own features, those of the token before, those of the token after
    beside = [y[live] for y in (ids[:, 1:-1], ids[:, :-2], ids[:, 2:])]
    onehot = np.eye(k)[np.maximum(gold, 0)] * live[:, :, None]
    params = [field.weights, field.moves, field.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    soft = lambda x, axis: (mx := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(mx, axis)).sum(axis=axis))
    for t in range(1, steps + 1):
        e = np.zeros((len(table), n, k))
        e[live] = sum(np.append(w, np.zeros((1, k)), 0)[at].sum(axis=1) for at, w in zip(beside, field.weights))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = field.first + e[:, 0]
        for j in range(1, n):
            alpha[:, j] = np.where(live[:, j, None], soft(alpha[:, j - 1, :, None] + field.moves, 1) + e[:, j], alpha[:, j - 1])
        for j in range(n - 2, -1, -1):
            beta[:, j] = np.where(live[:, j + 1, None], soft(field.moves + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        z = soft(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        diff = p - onehot
        g_moves = np.zeros_like(field.moves)
        for j in range(1, n):
            pair = alpha[:, j - 1, :, None] + field.moves + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]
            g_moves += (np.exp(pair) * live[:, j, None, None]).sum(0) - onehot[:, j - 1].T @ onehot[:, j]
        flat = np.repeat(diff[live], width, axis=0)
        g_weights = np.stack([np.stack([np.bincount(at.ravel(), flat[:, c], len(names) + 1)[:-1] for c in range(k)], 1) for at in beside])
        for i, g in enumerate((g_weights, g_moves, diff[:, 0].sum(0))):
            g = g / len(table) + ridge * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    plain = np.repeat(field.emissions(["word", "Word", "word.", "WORD", "word,", "x", "word"], {})[None], 1, 0)
    if viterbi(plain, np.array([plain.shape[1]]), field).any():
        raise ValueError("the field finds personal data in plain words; its training table is not fit for use")
    return field


def stretches(text: str, around: int = 4) -> list[list[tuple[int, int]]]:
    """Token ranges near tokens with a digit, an at sign or a cue; neighbours within ``around`` tokens of each come along,
    and ranges that meet are one."""
    found: list[list[tuple[int, int]]] = []
    covered = cued = -1
    for m in _CUE.finditer(text):
        if m.start() < cued or m[0] in "[({" and not _SPELT.match(text, m.start()):
            continue
        lo, hi = m.start(), m.end()
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        cued = hi  # the end of the cue's token: further cues in it add nothing
        for _ in range(around + 1):
            lo = _word_start(text, lo, covered)
        for _ in range(around):
            hi = _word_end(text, hi)
        if hi <= covered:
            continue
        part = [t.span() for t in _TOKEN.finditer(text, max(lo, covered, 0), hi)]
        if found and lo <= covered:
            found[-1] += part
        else:
            found.append(part)
        covered = hi
    return found


def _word_start(text: str, at: int, floor: int) -> int:
    while at > max(floor, 0) and text[at - 1].isspace():
        at -= 1
    while at > max(floor, 0) and not text[at - 1].isspace():
        at -= 1
    return at


def _word_end(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def field_spans(texts: list[str], field: Field, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans that the field marks in each text, white space and outer signs trimmed."""
    todo = [(i, s) for i, t in enumerate(texts) for s in stretches(t)]
    todo.sort(key=lambda x: len(x[1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cache: dict[str, list[int]] = {}
    for lo in range(0, len(todo), batch):
        part = todo[lo : lo + batch]
        if len(part[-1][1]) > 4000:
            part_sets = [[x] for x in part]
        else:
            part_sets = [part]
        for group in part_sets:
            lengths = np.array([len(s) for _, s in group])
            e = np.zeros((len(group), lengths.max(), len(TAGS)))
            for r, (i, s) in enumerate(group):
                e[r, : len(s)] = field.emissions([texts[i][a:b] for a, b in s], cache)
            for (i, s), tags in zip(group, viterbi(e, lengths, field)):
                j = 0
                while j < len(s):
                    if not tags[j]:
                        j += 1
                        continue
                    kind, k = (tags[j] - 1) // 2, j + 1
                    while k < len(s) and tags[k] and (tags[k] - 1) // 2 == kind and tags[k] % 2 == 0:
                        k += 1
                    a, b = s[j][0], s[k - 1][1]
                    while b > a and texts[i][b - 1] in _TRIM:
                        b -= 1
                    while a < b and texts[i][a] in _TRIM and texts[i][a] != "(":
                        a += 1
                    if b > a:
                        out[i].append((a, b, int(kind)))
                    j = k
    return out


def valid(text: str, span: tuple[int, int, int]) -> bool:
    """Checks that a span of the field must pass: digits as for the base kinds, an at (or two spelt marks) for e-mail."""
    part = text[span[0] : span[1]]
    digits = "".join(_DIGIT.findall(part))
    if span[2] == 0:
        return "@" in part[1:-1] or len(_SPELT.findall(part)) >= 2
    if span[2] == 1:
        numbers = re.findall("[0-9]+", part)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return 14 <= len(digits) <= 19 and luhn(digits) if span[2] == 2 else 10 <= len(digits) <= 15


def parts_of(text: str, span: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Numbers written side by side that the field took for one: a rejected span of digits cut at white space into stretches
    that each pass the check of cards, or open with a plus sign and pass that of phones. All of it must be covered so, as
    any long row of digit groups holds some stretch that would pass; else only whole tokens that pass as cards are parts."""
    at = [m.span() for m in _TOKEN.finditer(text, span[0], span[1])]
    best: list[list[tuple[int, int, int]] | None] = [[]] + [None] * len(at)
    for j in range(1, len(at) + 1):
        for i in range(max(0, j - 8), j):  # nineteen digits in groups of three and more
            if best[j] is None and best[i] is not None:
                a, b = at[i][0], at[j - 1][1]
                while b > a and text[b - 1] in _TRIM:
                    b -= 1
                kinds = [2] + [3] * (text[a] == "+") if CARD.fullmatch(text[a:b]) or text[a] == "+" else []
                fit_ = next((k for k in kinds if valid(text, (a, b, k))), None)
                if fit_ is not None:
                    best[j] = [*best[i], (a, b, fit_)]
    if len(at) < 2:
        return []
    cards = [(a, a + len(t), 2) for a, t in ((i, text[i:j].rstrip(_TRIM)) for i, j in at) if CARD.fullmatch(t)]
    return best[-1] or [c for c in cards if valid(text, c)]


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) per text, some hundred texts at a time; a field span that meets a base span is left out."""
    out = []
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        for text, extra in zip(part, field_spans(part, field)):
            base = base_spans(text)
            extra = [s for x in extra for s in ([x] if valid(text, x) else parts_of(text, x) if x[2] > 1 else [])]
            more = [s for s in extra if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
            out.append((base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of every whole text of ``docs`` (doc_id, text, ...): doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans and n_added. See the module docstring."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for base, every in all_spans([t or "" for t in pdf["text"]], field):
                counts = [sum(s[2] == k for s in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            made = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield made

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(ids).mapInPandas(searched, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind; n_chars, where present, follows. Null texts stay.

    Only the text goes to Python, and only a changed text comes back."""

    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done = all_spans([t or "" for t in texts], field)
            yield pd.Series([mask(t, every) if every else None for t, (_, every) in zip(texts, done)], dtype=object)

    # the row travels as one struct, so no name of its columns can meet one used here
    new = bounded(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.pandas_udf(replaced, T.StringType())(F.col("text").cast("string")).alias("new"))
    at = lambda c: F.col("row").getField(c)
    made = {"text": F.coalesce("new", at("text").cast("string"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(at("n_chars"))
    return new.select(*[made.get(c, at(c)).alias(c) for c in docs.columns])
