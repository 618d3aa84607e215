"""One form for texts that look the same but differ in their characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import settle, spread

# Letters of other alphabets with the shape of a Latin letter, by that letter.
SAME_SHAPE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ",
    "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
}
# Kinds of hyphen.
HYPHENS = "‐‑﹣－"
# Compatibility forms that are drawn in their own way and so stay as they are.
OWN_SHAPE = "ſϐϑϒϕϖϰϱϴϵ"

#: Letters of other alphabets and hyphens, by the Latin letter or sign of the same shape.
LOOKS = {ord(x): latin for latin, others in SAME_SHAPE.items() for x in others} | {ord(x): "-" for x in HYPHENS}
_FOLDED = {"<wide>", "<narrow>", "<noBreak>", "<small>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>"}
_SHOWN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_IGNORED = {0x34F, 0x180B, 0x180C, 0x180D, 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_SIGN = "[\u2600-\u27bf\ufe0f\U0001f000-\U0001faff]"
_JOINED_EMOJI = re.compile(f"(?<={_SIGN})\u200d(?={_SIGN})")
_JOINER = "\ue0ff"  # stands for a joiner that shows, since it makes two signs one


def _shape(c: int) -> str:
    """What one character looks like: Latin shapes, ordinary width, accents apart, parts; '' if invisible."""
    x = chr(c)
    if c < 128:
        return x
    if c in LOOKS:
        return LOOKS[c]
    kind = unicodedata.category(x)
    if c in _IGNORED or kind == "Cf" and c not in _SHOWN_FORMAT:
        return ""
    if kind == "Zs" and c != 0x1680:
        return " "
    parts = unicodedata.decomposition(x).split()
    if not parts:
        return unicodedata.normalize("NFD", x)
    if parts[0][0] == "<":
        codes = [int(p, 16) for p in parts[1:]]
        # a form that starts with a blank is an accent by itself, a long one a word sign
        if parts[0] not in _FOLDED or x in OWN_SHAPE or codes[0] == 32 or len(codes) > 3:
            return x
    else:
        codes = [int(p, 16) for p in parts]
    return "".join(map(_shape, codes))


class Shapes(dict):
    """A table for str.translate that fills itself by rule; `looks` are letters of further scripts by the readings they allow."""

    def __init__(self, looks: dict[int, tuple[str, ...]] | None = None) -> None:
        super().__init__()
        self.looks = looks or {}
        self.kinds: dict[int, str] = {}

    def __missing__(self, c: int) -> str:
        self[c] = made = self.looks[c][0] if c in self.looks else _shape(c)
        return made

    def readings(self, c: int) -> tuple[str, ...]:
        """What a character may pass for: its shape, several for one that looks like several letters, '' for an invisible one."""
        return self.looks.get(c) or (self[c],)


class _Kinds(dict):
    """A table for str.translate: `t` for a character that shows letters and accents only (`a`: of ASCII), `i` for an invisible
    one, `s` for one that shows none of these, `x` for one that shows both."""

    def __init__(self, shapes: Shapes) -> None:
        super().__init__()
        self.shapes = shapes

    def __missing__(self, c: int) -> str:
        letters = {unicodedata.category(y)[0] in "LM" for y in self.shapes[c]}
        self[c] = made = "i" if not letters else "x" if len(letters) > 1 else "s" if False in letters else "a" if c < 128 else "t"
        return made


SHAPES = Shapes()


def skeleton(text: str, shapes: Shapes = SHAPES) -> str:
    """The shape of a text by table: equal for texts that look the same, different otherwise."""
    if text.isascii():
        return text
    if "\u200d" in text:
        text = _JOINED_EMOJI.sub(_JOINER, text)
    return unicodedata.normalize("NFD", text.translate(shapes))


# Scripts for which SAME_SHAPE holds; their other letters only resemble Latin ones.
SETTLED_SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "LATIN")
# Letters of those scripts that look like several Latin ones.
SEVERAL = {"\u04c0": ("I", "l"), "\u04cf": ("l", "I")}
_FOUND: dict[int, tuple[str, ...]] = {}


def public_looks(spark: SparkSession) -> dict[int, tuple[str, ...]]:
    """Letters of further scripts with the shape of Latin ones, by the public table of confusable characters (Unicode UTS 39).

    The table is the one that the JVM's ICU library holds; nothing of it is copied here. Taken are
    letters read from left to right whose prototype is one Latin letter, of the same case where the
    script has cases. The prototype `l` stands for all upright strokes, so its letters may be read
    as I or l (the first where nothing decides): the vocabulary settles which.
    """
    if not _FOUND:
        letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] == "L" and not unicodedata.decomposition(chr(c)) and unicodedata.bidirectional(chr(c)) == "L"]
        letters = [x for x in letters if unicodedata.name(x, "").split(" ")[0] not in (*SETTLED_SCRIPTS, "CJK", "HANGUL", "TANGUT", "")]
        prototypes = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\0".join(letters)).split("\0")
        for x, p in zip(letters, prototypes, strict=True):
            if len(p) != 1 or not p.isascii() or not p.isalpha():
                continue
            if p == "l":
                _FOUND[ord(x)] = ("I", "l")
            elif (x.isupper(), x.islower()) in ((False, False), (p.isupper(), p.islower())):
                _FOUND[ord(x)] = (p,)
        _FOUND.update((ord(x), readings) for x, readings in SEVERAL.items())
    return _FOUND


class SpellingTrie:
    """Canonical spellings by what they look like, walked by a weighted edit automaton.

    The automaton reads a token's characters as they stand (accents apart). A state is a node and
    the cost so far. An edge is what a character of a spelling looks like: a character follows, at
    cost 0, every edge that it may pass for (its look-alikes, one edge after another for a joined
    letter), and an ignorable one stays where it is; any other substitution, insertion or deletion
    costs 1. `find` gives the spelling of least cost up to `max_cost`; of equals the one that was
    added first. So a character that looks like several letters is read as the one that makes a
    known spelling.
    """

    def __init__(self, spellings: Iterable[str] = (), shapes: Shapes = SHAPES) -> None:
        self.root: dict = {}
        self.shapes = shapes
        self.size = 0
        for s in spellings:
            self.add(s)

    def add(self, spelling: str) -> None:
        """A spelling in letters that look like one only; the first of those that look the same stands for all."""
        node = self.root
        for x in unicodedata.normalize("NFD", spelling):
            readings = self.shapes.readings(ord(x))
            if len(readings) > 1:
                return
            for y in readings[0]:
                node = node.setdefault(y, {})
        node.setdefault("", (self.size, spelling))
        self.size += 1

    def find(self, token: str, max_cost: int = 0) -> tuple[str, int] | None:
        states = self._skip({id(self.root): (self.root, 0)}, max_cost)
        for x in unicodedata.normalize("NFD", token):
            then: dict[int, tuple[dict, int]] = {}
            for reading in self.shapes.readings(ord(x)):
                way = states
                for y in reading:
                    way = self._step(way, y, max_cost)
                for node, cost in way.values():
                    self._reach(then, node, cost, max_cost)
            if not then:
                return None
            states = then
        ends = [(cost, *node[""]) for node, cost in states.values() if "" in node]
        if not ends:
            return None
        cost, _, spelling = min(ends)
        return spelling, cost

    def _step(self, states: dict[int, tuple[dict, int]], y: str, most: int) -> dict[int, tuple[dict, int]]:
        """States after one shape: its edge, and edits where the cost allows any."""
        then: dict[int, tuple[dict, int]] = {}
        for node, cost in states.values():
            if y in node:
                self._reach(then, node[y], cost, most)
            if cost < most:
                self._reach(then, node, cost + 1, most)  # y is surplus
                for z, kid in node.items():
                    if z and z != y:
                        self._reach(then, kid, cost + 1, most)
        return self._skip(then, most) if most else then

    @staticmethod
    def _reach(states: dict[int, tuple[dict, int]], node: dict, cost: int, most: int) -> None:
        if cost <= most and (id(node) not in states or states[id(node)][1] > cost):
            states[id(node)] = (node, cost)

    def _skip(self, states: dict[int, tuple[dict, int]], most: int) -> dict[int, tuple[dict, int]]:
        """States reached as well by leaving out characters of the spelling."""
        queue = list(states.values())
        for node, cost in queue:
            if cost >= most:
                continue
            for y, kid in node.items():
                if y and (id(kid) not in states or states[id(kid)][1] > cost + 1):
                    states[id(kid)] = (kid, cost + 1)
                    queue.append((kid, cost + 1))
        return states


_ORDINARY = Shapes({ord(x): (x,) for others in SAME_SHAPE.values() for x in others})
#: Tokens by the kinds of their characters: those of ASCII letters alone are their own spelling.
_TOKEN = re.compile("a*[ti][ati]*")


class Canonical:
    """Texts in canonical form: spellings of the vocabulary (most frequent first), and the table for all else.

    Of words that look the same the first spelling stands for all, but those that can be written in
    ASCII are: so a Russian word stays Russian wherever it is found, a disguised Latin one becomes Latin.
    """

    def __init__(self, vocabulary: Iterable[str], looks: dict[int, tuple[str, ...]] | None = None, cache: int = 500_000) -> None:
        self.shapes = Shapes({ord(x): readings for x, readings in SEVERAL.items()} if looks is None else looks)
        self.trie = SpellingTrie(shapes=self.shapes)
        for w in vocabulary:
            shape = skeleton(w, self.shapes)
            self.trie.add(shape if shape.isascii() else unicodedata.normalize("NFC", skeleton(w, _ORDINARY)))
        self.kinds = _Kinds(self.shapes)
        self.known: dict[str, str] = {}
        self.cache = cache

    def token(self, token: str) -> str:
        shape = skeleton(token, self.shapes)
        # accents around an invisible character may stand in another order than the trie's
        found = self.trie.find(token) or self.trie.find(shape)
        made = unicodedata.normalize("NFC", shape) if found is None else found[0]
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[token] = made
        return made

    def text(self, text: str) -> str:
        """Tokens are what shows as a run of letters and accents, so texts that look the same have the same tokens.

        Characters of ASCII are their own shape, so only tokens with others are looked up.
        """
        if text.isascii():
            return text
        if "\u200d" in text:
            text = _JOINED_EMOJI.sub(_JOINER, text)
        kinds = text.translate(self.kinds)
        if "x" in kinds:
            text = "".join(self.shapes[ord(x)] if k == "x" else x for x, k in zip(text, kinds, strict=True))
            kinds = text.translate(self.kinds)
        known, token, shapes = self.known, self.token, self.shapes
        out, done = [], 0
        for m in _TOKEN.finditer(kinds):
            i, j = m.span()
            if i > done:
                between = text[done:i]
                out.append(between if between.isascii() else between.translate(shapes))
            part = text[i:j]
            made = known.get(part)
            out.append(token(part) if made is None else made)
            done = j
        out.append(text[done:].translate(shapes))
        return unicodedata.normalize("NFC", "".join(out))


def vocabulary(docs: DataFrame, *, text: str = "text", size: int = 50_000, least: int = 2) -> list[str]:
    """Canonical spellings, most frequent first: the words of all texts that occur `least` times, at most `size` of them.

    Counts cover every text, in one scan; only the list is bounded. A word beyond it takes the
    table's form, which is equal for all that look the same; only a letter that looks like several
    is then read as the table reads it. Of equally frequent words the first in order goes first.
    """
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.col(text), r"[^\p{L}\p{M}]+")).alias("w"))
    counts = words.where("w <> ''").groupBy("w").count().where(F.col("count") >= least)
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(size).collect()]


def canonical_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spellings: list[str] | None = None, looks: dict[int, tuple[str, ...]] | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, blank, look, stored) and, if asked for, canonical: each text in its one form.

    Method: tokens go through a trie of canonical spellings by a weighted edit automaton with
    zero cost for look-alikes and ignorables, which selects the spelling; unmatched tokens are
    normalised by table. `look` is a 128-bit digest of the canonical text, equal for texts that
    look the same; `stored` one of the text as stored; `blank` marks texts that show nothing.
    `spellings` are in order of preference, by default the texts' own `vocabulary`; `looks` are
    letters of further scripts, by default those of `public_looks`.
    Null texts are left out; an empty text is blank. Texts of any length are processed whole.
    Two documents may share an identifier; each row is kept.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((vocabulary(docs, text=text) if spellings is None else spellings, public_looks(spark) if looks is None else looks))
    schema = "doc_id bigint, blank boolean, look binary, stored binary" + ", canonical string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canonical(*held.value)
        for b in batches:
            texts = b["text"].to_pylist()
            made = [form.text(t) for t in texts]
            columns = [b["doc_id"], pa.array([not m.strip() for m in made]), pa.array(map(_digest, made), pa.binary()), pa.array(map(_digest, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(made)] * keep_text, ["doc_id", "blank", "look", "stored", "canonical"][: 4 + keep_text])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, schema)


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_classes(forms: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): documents whose text looks like another that is stored otherwise, with the class (its
    lowest doc_id) and the number of documents it is linked with.

    The safe form of `look_pairs`: counts per class and stored form are made before any join, so a
    class of any size is one row for each document. Equal texts are not linked with each other. A
    document identifier that comes twice with texts of one class comes twice.
    """
    shown = settle(forms.where("NOT blank").select("doc_id", "look", "stored"), "looks")
    sizes = shown.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    several = sizes.groupBy("look").agg(F.sum("n").alias("total"), F.min("low").alias("class_id"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
    links = sizes.join(several, "look").select("look", "stored", "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    return shown.join(links, ["look", "stored"]).select("doc_id", "class_id", "n_links")


def look_pairs(forms: DataFrame, *, part_rows: int = 2_000) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of documents whose texts differ but look the same.

    Documents whose text is stored in one way only, however many copies there are, are set
    aside before the join; what remains is joined on the digest of the canonical text, and a
    pair of equal texts never forms. A class of more than `part_rows` documents is split: each
    document goes to one of its parts on the one side and to all on the other, so no task gets a
    whole class. The digests are written down first: texts are read once.
    """
    shown = settle(forms.where("NOT blank").select("doc_id", "look", "stored"), "looks")
    sizes = shown.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    part = shown.join(sizes.select("look", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "look")
    a = part.select(F.col("doc_id").alias("doc_id_a"), "look", F.col("stored").alias("stored_a"), F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    b = part.select(F.col("doc_id").alias("doc_id_b"), "look", F.col("stored").alias("stored_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["look", "part"]).where("doc_id_a < doc_id_b AND stored_a <> stored_b").select("doc_id_a", "doc_id_b").distinct()
