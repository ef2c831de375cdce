"""Variant spellings of names.

The names of a book are shards of tries. All forms of a name are keys: names and aliases as they
stand, the parts of names, and derived forms (titles, initials, nicknames). Every spelling is brought to a
plain form and walked through the trie with a Levenshtein automaton that counts a swap of neighbours as one
edit; names and aliases count up to a distance that grows with their length, derived forms only when met
exactly. What the walks of a spelling's parts find is then checked for an order of the parts that makes them a name.
The best kind of evidence counts, and only if it names one person.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollwork.llm.confusables import install, normal_form, public_table

#: Two-character family names.
DOUBLE_NAMES = frozenset("南荣 澹台 东郭 梁丘 漆雕 公羊 即墨 百里 闾丘 羊舌 欧阳 司马 上官 诸葛 夏侯 皇甫 尉迟 公孙 慕容 令狐 钟离 宇文 长孙 司徒 司空 公冶 端木 申屠 轩辕 太史 东方 独孤 南宫 西门 呼延 赫连 濮阳 淳于 单于 万俟 闻人 公西 左丘 谷梁 拓跋 乐正 宗政".split())
#: Forms of address.
TITLES_AFTER = "大小姐 师兄 师弟 师姐 师妹 师叔 师伯 师父 师傅 掌柜 先生 姑娘 统领 公子 少爷 大人 小姐 夫人 船长 将军 道长 大侠 老爷 哥儿 大哥 姐姐".split()
TITLES_BEFORE = frozenset("captain capt cap dr doctor old mr mrs ms miss sir lady lord master herr frau meister doktor kapitän kapitan fräulein don doña dona capitán capitan señor señora senor maestro maître maitre capitaine monsieur madame mademoiselle docteur docteure vieux vieille alte alter alten viejo vieja el la le der die das young jung joven jeune".split())
PARTICLES = frozenset("de von van der den du di da del la le y zu".split())
NICK_ENDS = ("ie", "y", "o", "i", "ey", "chen", "ito", "ita")
_CJK = re.compile("[㐀-鿿豈-﫿]")
_SPLIT = re.compile(r"[\s·•・．.,，、;；|/／\-‐‑–—－_]+")
_NOTE = re.compile(r"[（(\[【][^）)\]】]*[）)\]】]")
_EDGE = "\t\n\r 、，,。.；;：:！!？?·•・．\"'“”‘’「」『』《》-—…"


@lru_cache(1 << 16)
def plain(name: str) -> str:
    """`name` in usual characters, without notes in brackets, without accents, in lower case, edges trimmed."""
    s = normal_form(name)[0]
    s = _NOTE.sub("", s).strip(_EDGE + "　")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.casefold()).strip(_EDGE)


def parts(s: str) -> list[str]:
    return [p for p in _SPLIT.split(s) if p]


class Person:
    """The forms that one name of a person can take."""

    def __init__(self, name: str):
        s = plain(name)
        self.whole = parts(s)
        self.cjk = bool(_CJK.search(s))
        p = self.whole
        self.first = self.last = ""
        if self.cjk and len(p) == 1:
            n = 2 if len(p[0]) > 2 and p[0][:2] in DOUBLE_NAMES else 1
            self.last, self.first = p[0][:n], p[0][n:]
        elif self.cjk and p:
            self.first, self.last = p[0], p[-1]
        elif len(p) > 1:
            words = re.split(r"[\s,]+", s)
            words = [w for w in words if parts(w)]
            self.first = words[0]
            self.last = " ".join(words[1:])
        elif p:
            self.first = p[0]

    def forms(self) -> dict[str, int]:
        """form -> kind of evidence; the smaller the stronger."""
        out: dict[str, int] = {}

        def put(form: str, kind: int) -> None:
            if form and out.get(form, 9) > kind:
                out[form] = kind

        p = self.whole
        put(" ".join(p), 1)
        put("".join(p), 1)
        if not self.last:
            return out
        f, n = self.first, self.last
        if self.cjk and len(p) == 1:
            if f:
                put(f"{f} {n}", 2)
                put(f"{n} {f}", 2)
                put(f + n, 2)
            put("~" + n, 3)
            if len(f) > 1:
                put(f, 3)
                put("~" + f, 3)
            given = f or n  # a name of one character is called by it
            for y in {given, given[-1]}:
                for form in (f"小{y}", f"阿{y}", f"{y}儿", f"{y}哥儿"):
                    put(form, 4)
                if len(y) == 1:
                    put(y + y, 4)
            put(f"老{n}", 4)
            put(f"小{n}", 4)
        elif self.cjk:
            put(f + n, 2)
            put(n + f, 2)
            for x in (f, n):
                put(x, 3)
                put("~" + x, 3)
            put(f"{f[0]} {n}", 3)
            put(f"{n} {f[0]}", 3)
            put(f"{n}家的{f[0]}", 3)
            put(f"{n}家的{f}", 3)
            put(f"老{n}", 4)
            put(f"小{n}", 4)
        else:
            ff, nn = " ".join(parts(f)), " ".join(parts(n))
            bare = " ".join(w for w in nn.split() if w not in PARTICLES)
            for last in {nn, bare} - {""}:
                put(f"{last} {ff}", 2)
                put(f"{ff} {last}", 2)
                put(f"{ff[0]} {last}", 3)
                put(f"{last} {ff[0]}", 3)
                put(f"{ff} {last[0]}", 3)
                put(last, 3)
                put("~" + last, 3)
            put(ff, 3)
            put("~" + ff, 3)
            given = ff.split()[0]
            for k in range(3, len(given) + 1):
                if k < len(given):
                    put(given[:k], 5)
                for end in NICK_ENDS:
                    put(given[:k] + end, 5)
        return out


class Trie:
    """Keys with what belongs to them. A node is a dict of its children; at 0 it has what ends there as (what, near), at 1,
    if a key below it may be met at a distance, a bit for each length that is left to the end of such a key."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, what: object, near: bool = True) -> None:
        """`near`: whether the key counts at a distance too."""
        node = self.root
        for left, ch in zip(range(len(key), 0, -1), key):
            if near:
                node[1] = node.get(1, 0) | 1 << left
            node = node.setdefault(ch, {})
        if near:
            node[1] = node.get(1, 0) | 1
        ends = node.setdefault(0, [])
        if (what, near) not in ends:
            ends.append((what, near))

    def near(self, word: str, bound: int) -> dict[object, int]:
        """what -> least distance of its keys to `word`, up to `bound`: one walk of the automaton through the trie."""
        found: dict[object, int] = {}
        automaton = Automaton(word, bound)
        known = automaton.at
        stack = [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            end = state.end
            if 0 in node and end <= bound:
                for what, near in node[0]:
                    if (near or not end) and end < found.get(what, bound + 1):
                        found[what] = end
            exact, after = state.exact, state.after
            for nxt, below in node.items():
                if nxt == 0 or nxt == 1 or (nxt != exact and 1 not in below):
                    continue
                c = nxt if nxt in known else None
                new = after[c] if c in after else automaton.step(state, c)
                if new is not None and (nxt == exact or below[1] & new.left):
                    stack.append((below, new))
        return found


class _State:
    """end: the distance if the key ends here, above the bound if it is too far; exact: the next character of the word if all
    were met so far; left: a bit for each length that a near key may have left; after: character (None: one that the word
    lacks) -> next state or None; rows, swaps: see `Automaton`."""

    __slots__ = ("after", "end", "exact", "left", "rows", "swaps")


class Automaton:
    """Levenshtein automaton of a word that counts a swap of neighbours as one edit; its states are made when first met.

    Bit j of rows[d]: what was read is at most d edits from the word's first j characters. Bit j of swaps[d]: so
    was what was read before the last character, which is the word's character j + 1.
    """

    def __init__(self, word: str, bound: int):
        self.word, self.bound, self.full = word, bound, (2 << len(word)) - 1
        self.at: dict[str, int] = {}
        for j, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << j
        self.states: dict[tuple, _State] = {}
        self.start = self._state(tuple((2 << d) - 1 & self.full for d in range(bound + 1)), (0,) * bound)

    def _state(self, rows: tuple, swaps: tuple) -> _State:
        s = self.states.get((rows, swaps))
        if s is None:
            s = self.states[rows, swaps] = _State()
            n = len(self.word)
            s.rows, s.swaps, s.after = rows, swaps, {}
            s.end = next((d for d, r in enumerate(rows) if r >> n), self.bound + 1)
            j = rows[0].bit_length() - 1
            s.exact = self.word[j] if 0 <= j < n else None
            s.left = before = 0
            for d, r in enumerate(rows):
                more, new = self.bound - d, r & ~before
                while new:
                    low = n + 1 - (new & -new).bit_length() - more
                    span = (2 << 2 * more) - 1
                    s.left |= span << low if low >= 0 else span >> -low
                    new &= new - 1
                before = r
        return s

    def step(self, s: _State, c: str | None) -> _State | None:
        """The state after a character, None if no key can be near any more."""
        m = self.at.get(c, 0)
        old = s.rows
        last = (old[0] & m) << 1
        rows = [last]
        for d in range(1, len(old)):
            less = old[d - 1]
            last = ((old[d] & m) << 1 | less | less << 1 | last << 1 | (s.swaps[d - 1] & m) << 2) & self.full
            rows.append(last)
        new = self._state(tuple(rows), tuple(r & m >> 1 for r in old[:-1])) if last else None
        s.after[c] = new
        return new


def readings(spelling: str) -> list[tuple[str, int]]:
    """(form to look up, penalty) of a spelling, without and with what may be a form of address."""
    s = plain(spelling)
    if not s:
        return []
    out = [(" ".join(parts(s)), 0), ("".join(parts(s)), 0)]
    if _CJK.search(s):
        for t in TITLES_AFTER:
            if s.endswith(t) and len(s) > len(t):
                base = s[: -len(t)].rstrip(_EDGE)
                out += [(" ".join(parts(base)), 1), ("~" + " ".join(parts(base)), 0)]
                if base[:1] in "老小" and len(base) > 1:
                    out.append(("~" + base[1:], 1))
                break
    else:
        words = parts(s)
        k = 0
        while k < len(words) - 1 and words[k] in TITLES_BEFORE:
            k += 1
            out += [(" ".join(words[k:]), 1), ("~" + " ".join(words[k:]), 0)]
    return out


def _sound_gap(a: str, b: str) -> int:
    """How far two characters are apart in the standard's order, which goes by sound for the common ones."""
    try:
        x, y = a.encode("gb2312"), b.encode("gb2312")
    except UnicodeEncodeError:
        return 10_000
    if min(len(x), len(y)) < 2:  # a letter or digit has no sound to compare
        return 10_000
    if max(x[0], y[0]) > 0xD7:
        return 5_000
    return abs((x[0] - y[0]) * 94 + x[1] - y[1])


def _untitled(s: str) -> str:
    """A plain form without what may be a form of address; empty if it is nothing else."""
    if _CJK.search(s):
        for t in TITLES_AFTER:
            if s.endswith(t):
                return s[: -len(t)].rstrip(_EDGE)
        return s
    words = parts(s)
    while words and words[0] in TITLES_BEFORE:
        words.pop(0)
    return " ".join(words)


def _bound(word: str, cjk: bool) -> int:
    """How many edits a word of its length allows."""
    n = len(word)
    return (0 if n < 2 else 1 if n < 6 else 2) if cjk else (0 if n < 3 else 1 if n < 7 else 2 if n < 12 else 3)


def _squeezed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", s)


#: Kinds of evidence beside those of `Person.forms`: a part of a name, an alias.
PART, ALIAS = 0, 2


class Book:
    """The names of one book (or of a shard of them)."""

    def __init__(self, names: list[tuple[str, str]]):
        self.trie = Trie()
        self.full: dict[str, set[str]] = defaultdict(set)
        self.accented: dict[str, set[str]] = defaultdict(set)
        self.names: list[tuple[str, list[str]]] = []
        self.walked: dict[tuple[str, int, bool], list[tuple[int, int, int]]] = {}
        for who, name, main in names:
            p = Person(name)
            self.accented[who].add(self._accented(name))
            whole = "".join(p.whole) if p.cjk else " ".join(p.whole)
            if main:
                for form, kind in p.forms().items():
                    self.trie.add(form, (who, kind, form), near=kind == 1 and form == whole and len(whole) > 1)
                if len(whole) > 1:
                    self.full[who].add(whole)
            else:
                base = _untitled(" ".join(p.whole))
                base = base.replace(" ", "") if p.cjk else base
                for form in {" ".join(p.whole), "".join(p.whole)} - {""}:
                    self.trie.add(form, (who, ALIAS, form), near=form == base)
                if base and base != whole:
                    self.trie.add(base, (who, 9, base))
            if len(p.whole) > 1:
                self.names.append((who, p.whole))
                for i, part in enumerate(p.whole):
                    self.trie.add(part, (len(self.names) - 1, PART, i))

    def find(self, spelling: str) -> tuple[int, dict[str, bool]]:
        """(rank of the best evidence, the ids it names and whether each is the closer one); rank 99 if there is none.

        Among several ids the closer one counts if it is the only one, see `linked`: that is decided over all tries.
        """
        got: dict[str, int] = {}

        def put(who: str, rank: int) -> None:
            if rank < got.get(who, 99):
                got[who] = rank

        s = plain(spelling)
        cjk = bool(_CJK.search(s))
        for form, more in dict.fromkeys(readings(spelling)):
            bound = 0 if form.startswith("~") else _bound(form, cjk)
            for (who, kind, key), dist in self.trie.near(form, bound).items():
                if kind == PART:
                    continue
                if not dist:
                    if kind < 9:
                        put(who, kind * 10 + more)
                elif form != key and self._alike(form, key, cjk, kind != 1):
                    put(who, 60 + dist * 2 + more)
            if " " in form and not form.startswith("~") and min(got.values(), default=99) > 20:
                for who, dist, skipped in self._reordered(form.split(" "), bound, cjk):
                    put(who, 60 + dist * 2 + more if dist else (50 if skipped else 20) + more)
        if not got:
            return 99, {}
        best = min(got.values())
        if best < 60:
            # Evidence of one kind names one person or nobody; accents decide between people who differ in them.
            own = self._accented(spelling)
            return best, {w: any(own in x for x in self.accented[w]) for w, k in got.items() if k // 10 == best // 10}
        word = "".join(parts(s))
        return best, {w: cjk and self._sounds_like(word, w) for w, k in got.items() if k // 2 == best // 2}

    def _reordered(self, words: list[str], bound: int, cjk: bool) -> list[tuple[str, int, bool]]:
        """(who, distance, whether the words have a particle more) of the names that have the words as parts in some
        order; particles may be missing on either side."""
        met: dict[int, dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
        for i, w in enumerate(words):
            for name, part, dist in self._parts_near(w, min(bound, _bound(w, cjk)), cjk):
                met[name][i][part] = dist
        out = []
        for name, ways in met.items():
            who, whole = self.names[name]
            need = [i for i, w in enumerate(words) if w not in PARTICLES or i in ways]
            if any(i not in ways for i in need):
                continue
            best, skipped = bound + 1, False
            stack = [(0, 0, frozenset())]
            while stack:
                k, dist, used = stack.pop()
                if dist >= best:
                    continue
                if k == len(need):
                    if len(used) > 1 and all(p in used or x in PARTICLES for p, x in enumerate(whole)):
                        best, skipped = dist, len(used) < len(words)
                    continue
                if words[need[k]] in PARTICLES:
                    stack.append((k + 1, dist, used))
                stack += [(k + 1, dist + d, used | {p}) for p, d in ways[need[k]].items() if p not in used]
            if best <= bound:
                out.append((who, best, skipped))
        return out

    def _parts_near(self, word: str, bound: int, cjk: bool) -> list[tuple[int, int, int]]:
        """(name, part, distance) of the parts of names that a word may be meant as; spellings share most of their words."""
        asked = (word, bound, cjk)
        if asked not in self.walked:
            self.walked[asked] = [(name, part, dist) for (name, kind, part), dist in self.trie.near(word, bound).items() if kind == PART and (not dist or self._alike(word, self.names[name][1][part], cjk, False))]
        return self.walked[asked]

    @staticmethod
    def _alike(word: str, key: str, cjk: bool, alias: bool) -> bool:
        """Whether a word at a distance from a key may be meant as it; short ones need more than a small distance."""
        if sorted(word) == sorted(key):
            return True
        if not cjk:
            return min(len(word), len(key)) > 4 or _squeezed(word) == _squeezed(key)
        if len(key) > 3:
            return True
        if alias:
            return _near_sound(word, key)
        # A short Chinese name keeps its family name or all of its given name's characters.
        return key[0] == word[0] or (len(key) == 3 and key[1:] == word[1:])

    @staticmethod
    def _accented(name: str) -> str:
        return normal_form(name)[0].casefold().strip(_EDGE)

    def _sounds_like(self, word: str, who: str) -> bool:
        return any(_near_sound(word, full) for full in self.full[who])


def _near_sound(a: str, b: str) -> bool:
    return len(a) == len(b) and max((_sound_gap(x, y) for x, y in zip(a, b) if x != y), default=0) <= 25


def _match_shard(names: pd.DataFrame, spellings: pd.DataFrame) -> pd.DataFrame:
    cols: dict[str, list] = {"book": [], "spelling": [], "rank": [], "character_id": [], "closer": []}
    if len(names) and len(spellings):
        by, asked = defaultdict(list), defaultdict(list)
        for b, w, n, main in zip(names["book"], names["id"], names["name"], names["main"]):
            by[b].append((w, n, main))
        for b, s in zip(spellings["book"], spellings["spelling"]):
            asked[b].append(s)
        for b, some in asked.items():
            if b not in by:
                continue
            book = Book(by[b])  # one at a time, whatever the number of books in the shard
            for s in some:
                rank, ids = book.find(s)
                # Two are enough to know that it isn't one, of the closer ones as of all.
                for who in sorted(ids, key=lambda w: (not ids[w], w))[:2]:
                    cols["book"].append(b)
                    cols["spelling"].append(s)
                    cols["rank"].append(rank)
                    cols["character_id"].append(who)
                    cols["closer"].append(ids[who])
    return pd.DataFrame({k: pd.Series(v, dtype={"rank": "int32", "closer": "bool"}.get(k, object)) for k, v in cols.items()})


def linked(spellings: DataFrame, characters: DataFrame, names_per_trie: int = 2_000, spellings_per_task: int = 2_000) -> DataFrame:
    """Rows (book, spelling, character_id) for the spellings that mean one character of their book.

    spellings: (book, spelling); those equal to a name or alias of the book, null and blank ones have
    no row, nor have spellings whose best evidence fits several characters. Books share tasks; one with more names than
    `names_per_trie` is cut into several tries, whose best finds are compared and their ties broken together, and one with more
    spellings than `spellings_per_task` is spread.
    """
    listed = characters.select("book", "id", F.explode(F.concat(
        F.array(F.struct(F.col("name").alias("n"), F.lit(True).alias("main"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("n"), F.lit(False).alias("main"))),
    )).alias("x")).select("book", "id", F.col("x.n").alias("name"), F.col("x.main").alias("main")).where("name is not null and id is not null").distinct()
    asked = spellings.select("book", "spelling").where("spelling <> ''").distinct().join(listed.select("book", F.col("name").alias("spelling")), ["book", "spelling"], "left_anti")
    n_n = listed.groupBy("book").agg(F.count(F.lit(1)).alias("n_n"))
    n_s = asked.groupBy("book").agg(F.count(F.lit(1)).alias("n_s"))
    sized = n_n.join(n_s, "book").select("book", F.ceil(F.col("n_n") / names_per_trie).cast("int").alias("tries"), F.ceil(F.col("n_s") / spellings_per_task).cast("int").alias("tasks"), "n_n", "n_s")
    big = sized.where("tries > 1 or tasks > 1").select("book", "tries", "tasks")
    # A shard has about as many names and spellings as a trie and a task may have, whatever the number of books.
    names_, words_ = sized.agg(F.coalesce(F.sum(F.col("n_n") * F.col("tasks")), F.lit(0)), F.coalesce(F.sum(F.col("n_s") * F.col("tries")), F.lit(0))).first()
    shards = max(2 * characters.sparkSession.sparkContext.defaultParallelism, -(-names_ // names_per_trie), -(-words_ // spellings_per_task))
    numbers = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(c) - 1))
    names = listed.join(big, "book", "left").withColumn("trie", F.when(F.col("tries").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("tries")))).withColumn("task", F.explode(numbers("tasks")))
    words = asked.join(big, "book", "left").withColumn("task", F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("spelling"), F.col("tasks")))).withColumn("trie", F.explode(numbers("tries")))
    shard = F.when(F.col("tries").isNull(), F.pmod(F.xxhash64("book"), F.lit(shards))).otherwise(F.xxhash64("book", F.col("trie").cast("long"), F.col("task").cast("long")))
    names = names.select(shard.alias("shard"), "book", "id", "name", "main")
    words = words.select(shard.alias("shard"), "book", "spelling")
    # A stated number of partitions: by their few bytes the shards would be put together into one task.
    names, words = names.repartition(shards, "shard"), words.repartition(shards, "shard")
    public = public_table(characters.sparkSession)

    def run(key: tuple, names: pd.DataFrame, spellings: pd.DataFrame) -> pd.DataFrame:
        install(public)
        return _match_shard(names, spellings)

    finds = names.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(run, "book string, spelling string, rank int, character_id string, closer boolean")
    # Ranks of one kind of evidence (tens, from 60 on pairs) are equal.
    kind = F.when(F.col("rank") < 60, F.floor(F.col("rank") / 10)).otherwise(60 + F.floor((F.col("rank") - 60) / 2))
    best = finds.withColumn("kind", kind).groupBy("book", "spelling").agg(F.min("kind").alias("_k"), F.collect_set(F.struct("kind", "character_id", "closer")).alias("_all"))
    ids = F.filter("_all", lambda x: x["kind"] == F.col("_k"))
    # Accents and sounds decide only here, as those they decide between may come from different tries.
    closer = F.filter(ids, lambda x: x["closer"])
    one = F.when(F.size(ids) == 1, F.element_at(ids, 1)["character_id"]).when(F.size(closer) == 1, F.element_at(closer, 1)["character_id"])
    return best.select("book", "spelling", one.alias("character_id")).where("character_id is not null")
