"""Text that was once decoded with the wrong character encoding.

For every pair of a true and a wrong encoding the garbled sequences of the corpus's own
characters are computed beforehand and put into one multi-pattern automaton: characters of several bytes as
they stand; letters of one byte within a Latin word with their neighbours, where the corpus's counts say that another
letter belongs there; pairs of Cyrillic letters; and the signs that only a failed decoding leaves behind. Every finding
starts from a match of the automaton. A match weighs as much as the true character is more frequent in the corpus than the
stored sequence. Matches of one pair that follow each other make a span; only spans with enough weight count, and only
they are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that text is wrongly read in, and those it is truly in.
SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "iso8859-2", "iso8859-5", "iso8859-7", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "mac_cyrillic")
WIDE = ("gbk", "big5", "cp949", "cp932", "euc_jp")
LATIN_TRUE = ("cp1252", "mac_roman", "cp850", "cp437")
CYRILLIC_TRUE = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: Signs that can stand in no text read rightly: the replacement character, control codes and private places.
HOPELESS = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff\U000f0000-\U0010ffff]")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
_ODD = re.compile("[\u3100-\u312f\ufe30-\ufe6f\uff61-\uff9f\uac00-\ud7a3\u2500-\u257f\u0384-\u03ff\u02c6-\u02ff]")
_HAN = re.compile("[\u3400-\u9fff]")
_LETTER = re.compile("[^\\W\\d_]")
_GAP = frozenset(" \n\r\t\u3000")
_NATURAL = frozenset("\u00bb\u00ae\u00a9\u00b0\u00ba \u00aa\u00b7\u00ab\u00a7\u00b6\u00a3\u00bf\u00a1\xa0")


def _read(b: bytes, wrong: str) -> str:
    """`b` as read in `wrong`; single-byte readers give undefined bytes the control code of the same number."""
    if wrong in WIDE:
        return b.decode(wrong)
    return "".join(_table(wrong)[x] for x in b)


_TABLES: dict[str, list[str]] = {}


def _table(enc: str) -> list[str]:
    if enc not in _TABLES:
        t = []
        for i in range(256):
            try:
                t.append(bytes([i]).decode(enc))
            except UnicodeDecodeError:
                t.append(chr(i))
        _TABLES[enc] = t
    return _TABLES[enc]


_CYRILLIC_WORD = re.compile("[\\u0400-\\u045f]{2,}")


def _char_class(chars: set[str]) -> str:
    return f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"


@lru_cache(1)
def behind() -> dict[str, frozenset[str]]:
    """sign -> the Latin letters of one byte that it can be the garbled form of, over all pairs."""
    out: dict[str, set[str]] = defaultdict(set)
    for wrong in SINGLE:
        for true in LATIN_TRUE:
            if true != wrong:
                for x, m in zip(_table(wrong)[128:], _table(true)[128:]):
                    if x != m and (m.isalpha() and m < "ƀ" or m == "’"):
                        out[x].add(m)
    return {x: frozenset(v) for x, v in out.items()}


@lru_cache(1)
def _inner_signs() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """(letter, sign, next character) of the signs of one byte and their letters after an ASCII letter; two ways, each fast on its kind of text."""
    c = _char_class(set(behind()).union(*behind().values()))
    return re.compile(f"([A-Za-z])({c})(?=(.?))", re.S), re.compile(f"(?<=([A-Za-z]))({c})(?=(.?))", re.S)


def _contexts(t: str) -> Iterator[str]:
    few, many = _inner_signs()
    for a, x, z in (many if t.count(" ") * 20 > len(t) else few).findall(t):
        yield a + x + (z if z.isascii() and z.isalpha() else "_")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (gram, n) over all texts: counts of characters (one long), of the high characters of one-byte encodings after an
    ASCII letter with both neighbours (three long; what isn't an ASCII letter is `_`), and of pairs of Cyrillic letters.

    At most a row per code point, 52 x 53 per high character of the encodings, and one per pair of Cyrillic letters,
    however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.zeros(0x110000, np.int64)
        more: Counter[str] = Counter()
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            seen = np.bincount(codes)
            ones[: len(seen)] += seen
            for t in texts:
                if not t.isascii():
                    more.update(_contexts(t))
                    for word in _CYRILLIC_WORD.findall(t):
                        more.update(map("".join, zip(word, word[1:])))
        at = np.flatnonzero(ones)
        grams = [chr(i) for i in at.tolist() if not 0xD800 <= i < 0xE000]
        counts = [int(ones[ord(c)]) for c in grams]
        yield pa.RecordBatch.from_arrays([pa.array(grams + list(more), pa.string()), pa.array(counts + list(more.values()), pa.int64())], names=["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Span:
    start: int
    end: int
    restored: str | None
    pair: str


def _units(s: str) -> str:
    """UTF-8 bytes as characters: a node of the automaton searches its children one by one, so they must be few."""
    return s.encode("utf-8", "surrogatepass").decode("latin-1")


def _edge(ch: str) -> int:
    """How a character bounds a word beside it: 1 an ASCII letter or digit, 2 another letter but those of East Asia, else 0."""
    return 0 if not ch.isalnum() else 1 if ch < "\x80" else 2 if ch < "\u2e80" and ch.isalpha() else 0


@lru_cache(1)
def _hopeless() -> tuple[str, ...]:
    """The signs that stand in no text read rightly, as the first bytes of their UTF-8 form."""
    lost = [_units("\ufffd")] + [_units(chr(c)) for c in range(0x80, 0xA0) if c != 0x85]
    places = [(0xEE, 0x80, 0xC0), (0xEF, 0x80, 0xA4), (0xF3, 0xB0, 0xC0), (0xF4, 0x80, 0x90)]
    return (*lost, *(chr(lead) + chr(b) for lead, a, z in places for b in range(a, z)))


class Detector:
    """The automaton over garbled sequences, with the corpus's counts (gram -> n)."""

    def __init__(self, grams: dict[str, int]):
        import ahocorasick

        self.total = sum(n for g, n in grams.items() if len(g) == 1) or 1
        self.grams = grams
        self.base = math.log(self.total)
        self.logp = {g: math.log(n) - self.base for g, n in grams.items() if len(g) == 1}
        self.never = math.log(0.5) - self.base
        least = 3  # the same for every size of corpus: rarer characters are noise, the weights tell the rest
        known = [c for c in self.logp if c > "\x7f" and grams[c] >= least and not HOPELESS.match(c)]
        self.pairs: list[tuple[str, str, str]] = []
        found: dict[str, list[tuple[int, float, str | None]]] = defaultdict(list)

        def pair(true: str, wrong: str, kind: str) -> int:
            self.pairs.append((true, wrong, kind))
            return len(self.pairs) - 1

        def add(seq: str, p: int, c: str, restored: str | None) -> None:
            w = self._p(c) - (self.logp2(seq) if len(seq) == 2 and seq in grams else sum(map(self._p, seq)))
            if w > 2 and seq != c and not seq.isascii():
                found[seq].append((p, w, restored))

        wide = [c for c in known if ord(c) > 0x2000]
        for wrong in SINGLE:
            p, q = pair("utf-8", wrong, "utf8"), pair("gbk", wrong, "wide")
            for c in known:
                add(_read(c.encode(), wrong), p, c, c)
            for c in wide:
                try:
                    b = c.encode("gbk")
                except UnicodeEncodeError:
                    continue
                add(_read(b, wrong), q, c, c)
        for wrong in WIDE:
            p = pair("utf-8", wrong, "bytes")
            for c in wide:
                for lead in (0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF):
                    try:
                        s = (c.encode() + bytes([lead])).decode(wrong)
                    except UnicodeDecodeError:
                        continue
                    if all(ch > "\x7f" for ch in s) and self._p(c) - 1.5 - sum(map(self._p, s)) > 2:
                        found[s].append((p, 3.0, None))
            for c in known:
                if ord(c) < 0x800 and c.isalpha():
                    try:
                        add(c.encode().decode(wrong), p, c, None)
                    except UnicodeDecodeError:
                        pass
            # What the marks of any Chinese text begin with: their first two bytes, read as one character.
            for lead in ("‘", "，", "。") if wrong == "gbk" else ("“", "。") if wrong == "cp932" else ():
                found[lead.encode()[:2].decode(wrong)].append((p, 3.0, None))
            if wrong == "gbk":
                # A sign lost in UTF-8 and read again.
                found["��".encode().decode(wrong)[:2]].append((pair("�", wrong, "lost"), 99.0, None))
                continue
            aligned = wrong in ("big5", "cp949")
            q = pair("gbk", wrong, "cjk" if aligned else "bytes")
            for c in wide:
                try:
                    s = c.encode("gbk").decode(wrong)
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                add(s, q, c, c)
        self.cyr: dict[str, dict[str, str]] = {}
        self.cyr_keys: dict[str, frozenset[str]] = {}
        for wrong in (*CYRILLIC_TRUE, "latin-1", "cp1252", "mac_roman"):
            for true in CYRILLIC_TRUE:
                if true != wrong:
                    self.cyr[f"{true}>{wrong}"] = {x: m for x, m in zip(_table(wrong)[128:], _table(true)[128:]) if x != m}
                    self.cyr_keys[f"{true}>{wrong}"] = frozenset(_table(wrong)[128:])
        self.cyr_class = frozenset().union(*self.cyr_keys.values())
        self.cyr_runs = re.compile(_char_class(set(self.cyr_class)) + "+")
        self.cyr_total = sum(n for g, n in grams.items() if len(g) == 2) or 1
        self.cyr_least = math.log(0.3 / self.cyr_total)
        self.cyr_verdicts: dict[tuple[str, int, int], tuple] = {}

        for seq, what in self._context_sequences().items():
            found[seq] += [(pair("one byte", "one byte", kind), float(sure), best) for kind, (best, sure) in what.items()]
        seed = pair("Cyrillic", "one byte", "cyr")
        for seq in self._cyrillic_sequences():
            found[seq].append((seed, 0.0, None))
        start = pair("one byte", "one byte", "start")
        for a, z in ((0x2500, 0x2580), (0x384, 0x400), (0x400, 0x460)):
            for x in map(chr, range(a, z)):
                for seq in [x] if a == 0x2500 else [x + chr(c) for c in (*range(65, 91), *range(97, 123))]:
                    found[seq].append((start, 0.0, None))
        self.auto = ahocorasick.Automaton()
        for seq, what in found.items():
            best: dict[int, tuple[int, float, str | None]] = {}
            for x in what:
                if x[0] not in best or best[x[0]][1] < x[1]:
                    best[x[0]] = x
            self.auto.add_word(_units(seq), (len(seq), tuple(best.values())))
        lost = ((1, ((pair("?", "?", "lost"), 99.0, None),)),)
        for prefix in _hopeless():
            had = self.auto.get(prefix, None)
            self.auto.add_word(prefix, (1, (had[1] if had else ()) + lost[0][1]))
        self.auto.make_automaton()
        self.kinds = [k for _, _, k in self.pairs]

    def _p(self, c: str) -> float:
        return self.logp.get(c, self.never)

    def logp2(self, seq: str) -> float:
        return math.log(self.grams[seq]) - self.base

    def _context_sequences(self) -> dict[str, dict[str, tuple[str, bool]]]:
        """Letter, sign and next letter (or letter and sign, by what follows) where another letter belongs in the sign's place."""
        out: dict[str, dict[str, tuple[str, bool]]] = defaultdict(dict)
        for g in self.grams:
            if len(g) == 3 and g[1] in behind():
                a, x, z = g
                ways = {"sign": ""} | {"sign before letter": "é"} if z == "_" else {"sign within": z}
                for kind, nxt in ways.items():
                    verdict = self._judge(a, x, nxt)
                    if verdict:
                        out[a + x if z == "_" else g][kind] = verdict
        return out

    def _cyrillic_sequences(self) -> set[str]:
        """The garbled forms of the pairs of Cyrillic letters of which every word that `_cyrillic_words` is sure of has one.

        Such a word's pairs have a mean log frequency above -7.5 and gain more than 2.2 each on average; so in any mix of the
        two at least one pair is above. The mix below gives the fewest matches in text read rightly.
        """
        out = set()
        true = [(g, math.log(n / self.cyr_total)) for g, n in self.grams.items() if len(g) == 2]
        for name, t in self.cyr.items():
            back: dict[str, list[str]] = defaultdict(list)
            for x in self.cyr_keys[name]:
                back[t.get(x, x)].append(x)
            for b, p in true:
                for v in {b, b.upper(), b.title()} if b.islower() else {b}:
                    for x in back.get(v[0], ()):
                        for y in back.get(v[1], ()):
                            s = x + y
                            n = self.grams.get(s, 0)
                            now = math.log(n / self.cyr_total) if n else self.cyr_least
                            if s != v and 0.3 * (p + 7.5) + 0.7 * (p - now - 2.2) > 0:
                                out.add(s)
        return out

    # -- spans of the automaton -------------------------------------------------

    def matches(self, text: str) -> list[tuple[int, int, tuple]]:
        """(start, end, what) of all matches, in one pass of the automaton over the text."""
        hits = list(self.auto.iter(_units(text)))
        if not hits:
            return []
        lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
        at = np.cumsum(lead)[[h[0] for h in hits]].tolist()
        return [(end - n, end, what) for end, (_, (n, what)) in zip(at, hits)]

    def _chains(self, text: str, matches: list[tuple[int, int, tuple]]) -> Iterator[Span]:
        """Accepted spans of characters of several bytes."""
        open_: dict[int, list] = {}  # pair -> [start, end, weight, matches, parts]
        runs: dict[int, int] = {}
        done: list[tuple[int, list]] = []
        for start, end, what in matches:
            for p, w, restored in what:
                kind = self.kinds[p]
                if kind not in ("utf8", "wide", "cjk", "bytes"):
                    continue
                if kind == "bytes":
                    if runs.get(p, -1) < end:
                        s = self._run(text, start, end, p)
                        runs[p] = s[1]
                        yield from self._bytes(text, s, p)
                    continue
                o = open_.get(p)
                if o is not None:
                    if start < o[1]:
                        if start == o[5] and w > o[6]:  # a longer or heavier match at the same place
                            o[2] += w - o[6]
                            o[1], o[6] = end, w
                            o[4][-1] = (start, end, restored)
                        continue
                    if start == o[1] or (start - o[1] <= 3 and all(ch in _GAP for ch in text[o[1] : start])):
                        o[1], o[2], o[3], o[5], o[6] = end, o[2] + w, o[3] + 1, start, w
                        o[4].append((start, end, restored))
                        continue
                    done.append((p, o))
                open_[p] = [start, end, w, 1, [(start, end, restored)], start, w]
        done.extend(open_.items())
        # A pair that one span proves holds for the text's weaker matches of it too.
        sure = [self._accept(text, p, o) for p, o in done]
        proven = {p for (p, _), yes in zip(done, sure) if yes and self.kinds[p] == "utf8"}
        for (p, o), yes in zip(done, sure):
            if yes or p in proven:
                true, wrong, _ = self.pairs[p]
                out, at = [], o[0]
                for a, b, r in o[4]:
                    out += [text[at:a], r or ""]
                    at = b
                yield Span(o[0], o[1], "".join(out), f"{true}>{wrong}")

    def _accept(self, text: str, p: int, o: list) -> bool:
        start, end, weight, matches, parts = o[:5]
        kind = self.pairs[p][2]
        before, after = text[start - 1 : start], text[end : end + 1]
        if kind == "utf8":
            if weight < 6:
                return False
            if matches == 1:
                s, r = text[start:end], parts[0][2] or ""
                if len(s) == 2 and s[1] in _NATURAL and before.isupper() and not r.isupper():
                    return False
                if len(s) == 2 and s[0].isalpha() and s[1] in _NATURAL and not before.isalpha() and not after.islower():
                    return weight > 9 and bool(r.isalpha())
            return True
        near_han = bool(_HAN.match(before) or _HAN.match(after))
        if kind == "wide":
            # A word that goes on in its own letters is read rightly, unless the span is long.
            if matches < 6 and (before > "\x7f" and before.isalpha() and not _HAN.match(before) and text[start].isalpha() or after[:1] > "\x7f" and after[:1].isalpha() and not _HAN.match(after) and text[end - 1].isalpha()):
                return False
            return (matches >= 2 and weight >= 12) or (near_han and weight >= 7 and all(ch > "\x80" for ch in text[start:end]) and not (before.isascii() and before.isalpha() or after[:1].isascii() and after[:1].isalpha()))
        odd = any(_ODD.match(text[a:b]) for a, b, _ in parts)
        if odd and near_han and weight >= 4:
            return True
        return matches >= 2 and weight >= 15 and weight / matches >= (4 if matches < 5 else 3)

    def _run(self, text: str, start: int, end: int, p: int) -> tuple[int, int]:
        """The widest run around a seed of signs that the wrong encoding has, ASCII only where inside."""
        wrong = self.pairs[p][1]

        def fits(ch: str) -> bool:
            if ch <= "\x7f":
                return False
            try:
                ch.encode(wrong)
            except UnicodeEncodeError:
                return False
            return True

        while start > 0 and fits(text[start - 1]):
            start -= 1
        while end < len(text) and fits(text[end]):
            end += 1
        return start, end

    def _bytes(self, text: str, run: tuple[int, int], p: int) -> Iterator[Span]:
        true, wrong, _ = self.pairs[p]
        s = text[run[0] : run[1]]
        ends, data = [0], b""
        for ch in s:
            data += ch.encode(wrong)
            ends.append(len(data))
        if true == "utf-8":
            segments = [(m.start(), m.end(), m[0].decode("utf-8", "replace")) for m in _UTF8.finditer(data)]
        else:
            segments = [(0, len(data), data.decode(true, "replace"))]
        for a, b, r in segments:
            i = next(k for k, e in enumerate(ends) if e > a) - 1
            j = next(k for k, e in enumerate(ends) if e >= b)
            stored = s[i:j]
            w = sum(map(self._p, r)) - sum(map(self._p, stored))
            here, there = text[run[0] + i - 1 : run[0] + i] if run[0] + i else "", text[run[0] + j : run[0] + j + 1]
            latin = len(stored) == 1 and r.isalpha() and ord(r[0]) < 0x250
            if latin:
                ok = w > 4 and (here.isascii() and here.islower() or there.isascii() and there.islower())
            elif true == "utf-8":
                ok = w >= 8 and w >= 3 * len(r)
            else:
                ok = w >= 10 and w >= 3 * len(r) and "�" not in r[:-1]
            if ok:
                yield Span(run[0] + i, run[0] + j, r if "�" not in r else None, f"{true}>{wrong}")

    # -- single signs inside words ------------------------------------------------

    _START_SIGN = re.compile("(?<![^\\W_])[\\u2500-\\u257f\\u0384-\\u03ff\\u0400-\\u045f](?=[a-z]{2}|[A-Z]{2})|[\\u2500-\\u257f](?=[A-Za-z])|(?<=[A-Za-z])[\\u2500-\\u257f]")

    def _signs(self, text: str, matches: list[tuple[int, int, tuple]]) -> Iterator[Span]:
        """A sign within a Latin word that is rare between its neighbours, while a letter it may stand for is common there."""
        found: list[tuple[int, str]] = []
        clear = False
        for start, end, what in matches:
            for p, sure, best in what:
                kind = self.kinds[p]
                if kind == "lost":
                    yield Span(start, end, None, "lost")
                elif kind == "start":
                    if self._START_SIGN.match(text, start):
                        yield Span(start, start + 1, None, "sign")
                elif kind == "sign within" or (kind == "sign" and not _LETTER.match(text, end)) or (kind == "sign before letter" and text[end : end + 1] > "\x7f" and _LETTER.match(text, end)):
                    found.append((start + 1, best))
                    clear = clear or bool(sure)
        if clear:
            for at, best in found:
                yield Span(at, at + 1, best, "sign")

    def _judge(self, a: str, x: str, z: str) -> tuple[str, bool] | None:
        """(the letter that the sign x after a and before z stands for, whether that is sure by itself) or None."""
        if x in "’…":
            return None
        get = self.grams.get
        kz = z if z.isascii() and z.isalpha() else "_"
        here = get(a + x + kz, 0)
        odd = not x.isalpha() or (x.isupper() and a.islower()) or (ord(x) > 0x17F and x not in "\ufb01\ufb02")
        best, n = None, 0
        for c in sorted(behind()[x]):
            k = get(a + c + kz, 0)
            if k > n:
                best, n = c, k
        plain = not x.isalpha() and not (kz != "_" or _LETTER.match(z)) and x in _NATURAL | frozenset("“”„«»–—‘‚‹›")
        if best is None or plain:
            return None
        other = odd and x.isalpha() and ord(x) >= 0x370 and a.islower() and z.isascii() and z.islower()
        if other or (n >= 6 and n >= (4 if odd else 40) * (here + 0.25)):
            return best, not (best == "’" and x.isalpha() and not odd)
        return None

    # -- Cyrillic read in another Cyrillic or Latin encoding ----------------------------------------

    _LETTERS = re.compile("[\u0400-\u04ff]+")
    _STRONG = re.compile("[\u00c0-\u036f\u2500-\u257f\u0400-\u04ff]")

    _BESIDE = frozenset("\xa0«»„“”‚‘’‹›—–…•·№§°")

    def _score(self, s: str) -> float:
        get = self.grams.get
        return sum(math.log(n / self.cyr_total) if (n := get(s[i : i + 2], 0)) else self.cyr_least for i in range(len(s) - 1))

    def _stretch(self, text: str, at: int, end: int) -> tuple[tuple[int, int, str | None, str, bool], ...]:
        """`_cyrillic_words` of a stretch, remembered."""
        key = (text[at:end], _edge(text[at - 1]) if at else 0, _edge(text[end]) if end < len(text) else 0)
        got = self.cyr_verdicts.get(key)
        if got is None:
            if len(self.cyr_verdicts) > 200_000:
                self.cyr_verdicts.clear()
            got = self.cyr_verdicts[key] = self._cyrillic_words(*key)
        return got

    def _cyrillic(self, text: str, matches: list[tuple[int, int, tuple]]) -> Iterator[Span]:
        """Words of Cyrillic letters, whatever surrounds them: stretches of signs that a pair's table can produce around a
        match, in which the pieces that become letters are scored.

        Words of one letter, and of two if they could be right, count only next to a span of their pair.
        """
        done = -1
        for start, end, what in matches:
            if start < done or not any(self.kinds[p] == "cyr" for p, _, _ in what):
                continue
            while start and text[start - 1] in self.cyr_class:
                start -= 1
            done = self.cyr_runs.match(text, start).end()
            if any(x[4] for x in self._stretch(text, start, done)):
                break
        else:
            return
        sure: list[tuple[int, int, str | None, str]] = []
        weak: list[tuple[int, int, str | None, str]] = []
        for m in self.cyr_runs.finditer(text):
            for i, j, r, name, yes in self._stretch(text, *m.span()):
                (sure if yes else weak).append((m.start() + i, m.start() + j, r, name))
        grown = True
        while weak and grown:
            by_start, by_end = {(x[0], x[3]) for x in sure}, {(x[1], x[3]) for x in sure}
            near = [x for x in weak if any((x[0] - k, x[3]) in by_end and not any(map(str.isalnum, text[x[0] - k : x[0]])) or (x[1] + k, x[3]) in by_start and not any(map(str.isalnum, text[x[1] : x[1] + k])) for k in (1, 2, 3))]
            grown = bool(near)
            sure += near
            weak = [x for x in weak if x not in near]
        for i, j, r, name in sure:
            yield Span(i, j, r, name)

    def _cyrillic_words(self, run: str, before: int, after: int) -> tuple[tuple[int, int, str | None, str, bool], ...]:
        """(start, end, letters, pair, whether sure) of the garbled words in a run; before, after: see `_edge`."""
        if not self._STRONG.search(run):
            return ()
        edges = [before, *map(_edge, run), after]
        sure: list[tuple[float, int, int, str, str]] = []
        weak: list[tuple[int, int, str, str, bool]] = []
        for name, t in self.cyr.items():
            r = "".join([t.get(ch, ch if ch in self.cyr_keys[name] else " ") for ch in run])
            # A stretch with other signs than those usual beside words is garbled in some other way.
            if any(not self._LETTERS.match(x) and x not in self._BESIDE and ch not in self._BESIDE for x, ch in zip(r, run)):
                continue
            for m in self._LETTERS.finditer(r):
                i, j = m.span()
                tries = [(i, j)]
                while i < j and not self._STRONG.match(run[i]):
                    i += 1
                while i < j and not self._STRONG.match(run[j - 1]):
                    j -= 1
                for i, j in dict.fromkeys([*tries, (i, j)]):
                    n, s, w = j - i, run[i:j], r[i:j]
                    strong = len(self._STRONG.findall(s))
                    if not n or s == w or 2 * strong <= n or edges[i] == 2 or edges[j + 1] == 2 or (n < 3 and (strong < n or edges[i] or edges[j + 1])):
                        continue
                    if n == 1:
                        if w in "авикосуяАВИКОСУЯ" and s not in "авикосуяАВИКОСУЯ":
                            weak.append((i, j, w, name, False))
                        continue
                    low = self._score(w.lower()) if w[1:].islower() or w.isupper() else self._score(w)
                    now = self._score(s)
                    if n < 3 or not w[1:].islower():
                        now = max(now, self._score(s.lower()))
                    # Two small Cyrillic letters may be a rare word read rightly.
                    if low / (n - 1) > -7.5 and low - now > 2.2 * n and (n > 2 or not (self._LETTERS.match(s) and s[1:].islower())):
                        sure.append((now - low, i, j, w, name))
                    if n == 2 and low > -8 and low > now:
                        weak.append((i, j, w, name, False))
        # Of readings that overlap the one that gains most counts; two letters that can be read in several ways stay.
        out: list[tuple[int, int, str | None, str, bool]] = []
        for gain, i, j, w, name in sorted(sure, key=lambda x: (round(x[0], 6), x[2] - x[1])):
            if all(j <= o[0] or o[1] <= i for o in out):
                clear = j - i > 2 or all(x[3] == w or x[0] > gain + 3 for x in sure if x[1:3] == (i, j))
                out.append((i, j, w if clear else None, name if clear else "", True))
        return (*out, *weak)

    def _parts(self, text: str) -> Iterator[Iterator[Span]]:
        matches = self.matches(text)
        if matches:
            yield self._chains(text, matches)
            yield self._signs(text, matches)
            yield self._cyrillic(text, matches)

    def spans(self, text: str | None) -> list[Span]:
        """Garbled spans in order; where spans overlap the longer one stays. A null or ASCII text has none."""
        if not text or text.isascii():
            return []
        out = [s for part in self._parts(text) for s in part]
        out.sort(key=lambda s: (s.restored is None, s.start - s.end))
        taken: list[Span] = []
        used = bytearray(len(text))
        for s in out:
            if not any(used[s.start : s.end]):
                used[s.start : s.end] = b"\1" * (s.end - s.start)
                taken.append(s)
        return sorted(taken, key=lambda s: s.start)

    def is_garbled(self, text: str | None) -> bool:
        """Whether `spans` has any, ended at the first."""
        return bool(text) and not text.isascii() and any(True for part in self._parts(text) for _ in part)

    def restore(self, text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for s in spans:
            out += [text[at : s.start], text[s.start : s.end] if s.restored is None else s.restored]
            at = s.end
        return "".join([*out, text[at:]])


def garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", restore: bool = True) -> DataFrame:
    """Rows (key, n_spans, n_lost, restored) of texts with a garbled span, or (key) alone if not `restore`.

    `restored` is the text with every span that can be undone replaced; n_lost counts those that cannot.
    The counts are taken over all texts first and the automaton is made from them once, on the driver; both are bounded by the
    encodings and their characters, see `statistics`. Null, empty and ASCII texts have no row; equal texts
    each have their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Detector({r[0]: r[1] for r in statistics(docs, text).collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            at, n, lost, new = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not restore:
                    if d.is_garbled(t):
                        at.append(i)
                    continue
                s = d.spans(t)
                if s:
                    at.append(i)
                    n.append(len(s))
                    lost.append(sum(x.restored is None for x in s))
                    new.append(d.restore(t, s))
            cols = [b.column(0).take(pa.array(at, pa.int64()))]
            if restore:
                cols += [pa.array(n, pa.int32()), pa.array(lost, pa.int32()), pa.array(new, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_spans", "n_lost", "restored"][: len(cols)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}" + (", n_spans int, n_lost int, restored string" if restore else ""))
