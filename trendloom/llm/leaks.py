"""Passages of held-out evaluation items inside a corpus of mails."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.lookalike import LOOKS, skeleton
from trendloom.llm.mailparts import shown_parts
from trendloom.session import settle, spread

# Number words.
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
un deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
один два две три четыре пять шесть семь восемь девять десять одиннадцать двенадцать двадцать тридцать сорок пятьдесят сто тысяча
"""

_WORD = re.compile(r"[^\W_]+")
_CAPITAL = re.compile(r"(?<=[^\W\d_]) +([^\W\d_]+)")


def _case_shape(c: int) -> str:
    """A letter whose capital has the shape of a Latin one counts as that one in either case."""
    x = chr(c)
    up = x.upper()
    return LOOKS[ord(up)] if c > 127 and c not in LOOKS and len(up) == 1 and ord(up) in LOOKS else x


class _CaseShapes(dict):
    def __missing__(self, c: int) -> str:
        self[c] = made = _case_shape(c)
        return made


_CASES = _CaseShapes()


def folded(text: str) -> str:
    """Text in which case and look-alike characters make no difference."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", skeleton(text)).translate(_CASES)
    return text.casefold()


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, folded."""
    return _WORD.findall(folded(text))


def _code(word: str) -> int:
    """A 62-bit number of a word, above 16."""
    return (int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 2) + 16


NUMBER, UNIT, NAME = 1, 2, 3
_NUMBERS = frozenset(words(NUMBER_WORDS))


@dataclass(frozen=True)
class Lexicon:
    """What a word becomes in a template: a typed placeholder, or itself.

    Numbers are digits and number words; units are words that follow a number and names words
    that stand capitalised inside a sentence, both as the evaluation items use them.
    """

    units: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()

    @classmethod
    def of(cls, items: DataFrame, *, text: str = "text", most_words: int = 2_000_000) -> Lexicon:
        """Fitted on all items, by one aggregate over their words; only words that qualify leave it.

        More than `most_words` of these are an error: no language has as many, and a part of them
        would find other passages than all.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                after, seen, capital = Counter(), Counter(), Counter()
                for t in b["text"].to_pylist():
                    ws = words(t)
                    seen.update(ws)
                    after.update(y for x, y in zip(ws[:-1], ws[1:], strict=True) if x in _NUMBERS or x[0].isdigit())
                    capital.update(w for m in _CAPITAL.finditer(t) if m[1][0].isupper() and not m[1].isupper() for w in words(m[1]))
                yield pa.RecordBatch.from_pydict({"w": list(seen), "seen": list(seen.values()), "after": [after[w] for w in seen], "capital": [capital[w] for w in seen]}, schema=_COUNTED)

        counts = items.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "w string, seen bigint, after bigint, capital bigint")
        unit = (F.col("after") >= 3) & (2 * F.col("after") > F.col("seen"))
        found = counts.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("seen", "after", "capital"))).where(unit | (2 * F.col("capital") > F.col("seen"))).select("w", unit.alias("unit"))
        rows = found.limit(most_words + 1).collect()
        if len(rows) > most_words:
            raise ValueError(f"more than {most_words} units and names")
        usual = [r for r in rows if r["w"] not in _NUMBERS]
        return cls(frozenset(r["w"] for r in usual if r["unit"]), frozenset(r["w"] for r in usual if not r["unit"]))

    def kind(self, word: str) -> int:
        """The placeholder of a word, 0 for none."""
        return NUMBER if word in _NUMBERS or word[0].isdigit() else UNIT if word in self.units else NAME if word in self.names else 0


_COUNTED = pa.schema([("w", pa.string()), ("seen", pa.int64()), ("after", pa.int64()), ("capital", pa.int64())])


# Words for units, besides those that follow a number.
UNIT_WORDS = """
metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters millimetre millimetres millimeter millimeters
mile miles yard yards foot feet inch inches litre litres liter liters millilitre millilitres milliliter milliliters pint pints quart quarts gallon gallons barrel barrels
gram grams gramme grammes kilogram kilograms kilo kilos milligram milligrams tonne tonnes ton tons ounce ounces pound pounds stone stones acre acres hectare hectares
second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pence penny pennies
km cm mm ml kg mg lb lbs oz ft yd hr hrs min mins sec secs
"""

_UNITS = frozenset(words(UNIT_WORDS))
_TOKEN = re.compile(r"([^\W_]*)([\W_]*)")


_STOP = re.compile("[.!?:]")
_SEEN: dict[str, list[tuple[str, int, bool]]] = {}


def _seen(token: str) -> list[tuple[str, int, bool]]:
    """The words of a token (one, but where folding takes a letter apart): what each is anywhere, and whether it is capitalised."""
    capital = token[:1].isupper() and not (len(token) > 1 and token.isupper())
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    _SEEN[token] = made = [(w, NUMBER if w in _NUMBERS or w[0].isdigit() else UNIT if w in _UNITS else 0, capital) for w in _WORD.findall(token.casefold())]
    return made


def context_kinds(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and the placeholder of each (0 for none) by where it stands.

    Numbers are digits and number words; units words of a fixed list and words that follow a
    number; names words capitalised (but not in capitals) inside a sentence, which ends at a
    mark . ! ? : or at the end of the text. Line ends and quote marks end none. A name that
    begins a sentence stays a word.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", skeleton(text)).translate(_CASES).replace("\u0345", "ι")
    found, kinds, inside, after = [], [], False, False
    for token, gap in _TOKEN.findall(text):
        for w, own, capital in _SEEN.get(token) or _seen(token):
            kinds.append(own or (UNIT if after else NAME if inside and capital else 0))
            found.append(w)
            after = own == NUMBER
        if token or gap:
            inside = (bool(token) or inside) and (gap == " " or not _STOP.search(gap))
    return found, kinds


class Templates:
    """Texts as template codes and slot codes (0: no slot), by a lexicon and, if asked for, by context as well."""

    def __init__(self, lexicon: Lexicon, context: bool) -> None:
        self.lexicon, self.context = lexicon, context
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = made = (_code(word), self.lexicon.kind(word))
        return made

    def of(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(template, slots) of the words: placeholders by the lexicon, then those by context."""
        known, word = self.known, self._word
        ws, own = context_kinds(text) if self.context else (words(text), None)
        code, kind = np.array([known.get(w) or word(w) for w in ws], np.int64).reshape(-1, 2).T
        kinds = [kind] if own is None else [kind, np.array(own, np.int64)]
        return [(np.where(k, k, code), np.where(k, code, 0)) for k in kinds]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(template: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` template codes."""
    n = len(template) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    x = template.astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _BASE + x[i : i + n]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


@dataclass(frozen=True)
class Windows:
    """Windows that some text has, as bits by their hash: a filter of bounded size that lets all of them through, and few others."""

    bits: np.ndarray

    MOST = 1 << 28

    @classmethod
    def of(cls, windows: DataFrame, probe: str) -> Windows:
        """The bitmap is put together by an aggregate; the driver gets its pieces, at most 32 MB in all."""
        size = 1 << 15
        n = windows.count()
        while size < min(16 * n, cls.MOST):
            size *= 2
        at = F.pmod(F.col(probe), F.lit(size))
        pieces = windows.select(F.floor(at / 32_768).cast("int").alias("piece"), (at % 32_768).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        bits = np.zeros(size // 8, np.uint8)
        for r in pieces:
            bits[r["piece"] * 4_096 : (r["piece"] + 1) * 4_096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return cls(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


_LITERAL = "id bigint, part int, pos int, template bigint, slot_key bigint"
_WITH_SLOTS = "id bigint, part int, pos int, template bigint, slots array<bigint>"


def template_windows(texts: DataFrame, *, text_id: str, text: str, lexicon: Lexicon, width: int, mails: bool, literal: bool, least_fixed: int = 0, among: Windows | None = None) -> DataFrame:
    """Windows of `width` words, all of them or those whose hash is `among` others: (id, part, pos, template, ...).

    `template` is the hash of the words with placeholders for numbers, units and names. With
    `literal` follows slot_key, the hash of the words in the placeholders, by the lexicon alone;
    else `slots`, these words themselves, for placeholders by the lexicon and by context (one
    window where both agree). Windows of fewer than `least_fixed` words outside placeholders are
    left out. Null texts have no windows.
    """
    held = texts.sparkSession.sparkContext.broadcast((lexicon, among))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, only = held.value
        templates = Templates(lex, not literal)
        for b in batches:
            found = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for k, shown in enumerate(shown_parts(t) if mails else [t]):
                    before = None
                    for template, slot in templates.of(shown):
                        h = window_hashes(template, width)
                        if not len(h):
                            continue
                        key = window_hashes(slot, width) if literal else None
                        ok = np.ones(len(h), bool) if only is None else only.has(h ^ key if literal else h)
                        if before is not None:
                            ok &= h != before
                        before = h
                        at = np.flatnonzero(ok)
                        if least_fixed and len(at):
                            fixed = np.concatenate([[0], np.cumsum(slot == 0)])
                            at = at[fixed[at + width] - fixed[at] >= least_fixed]
                        if len(at):
                            found.append((i, k, at, h[at], key[at] if literal else slot[at[:, None] + np.arange(width)]))
            if found:
                ids, parts, at, h, more = zip(*found, strict=True)
                n = [len(x) for x in at]
                last = np.concatenate(more)
                columns = [np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(parts, np.int32), n), np.concatenate(at).astype(np.int32), np.concatenate(h)]
                lists = pa.array(last) if literal else pa.ListArray.from_arrays(pa.array(np.arange(len(last) + 1, dtype=np.int32) * width), pa.array(last.ravel()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["id", "part", "pos", "template", "slot_key" if literal else "slots"])

    rows = texts.where(F.col(text).isNotNull() & F.col(text_id).isNotNull()).select(F.col(text_id).cast("long").alias("id"), F.col(text).alias("text"))
    return (spread(rows) if mails else rows).mapInArrow(run, _LITERAL if literal else _WITH_SLOTS)


def _both_sides(docs: DataFrame, items: DataFrame, literal: bool, least_fixed: int, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, mails: bool = True) -> tuple[DataFrame, DataFrame]:
    """Windows of the documents that some item may have, and those of the items.

    The items' windows are written down once; the documents' tasks get a bitmap of them, of at
    most 32 MB however many items there are, and send only windows that it lets through.
    """
    lexicon = Lexicon.of(items, text=item_text)
    theirs = settle(template_windows(items, text_id=item_id, text=item_text, lexicon=lexicon, width=width, mails=False, literal=literal, least_fixed=least_fixed), "items")
    probe = theirs.withColumn("probe", F.col("template").bitwiseXOR(F.col("slot_key")) if literal else F.col("template"))
    ours = template_windows(docs, text_id=doc_id, text=text, lexicon=lexicon, width=width, mails=mails, literal=literal, among=Windows.of(probe, "probe"))
    return ours.withColumnRenamed("id", "doc_id"), theirs.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), *theirs.columns[3:])


def leaked_items(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """(doc_id, item_id): one part of the document holds a window of the item word for word.

    Method: numbers, units and names become typed placeholders (`Lexicon`, fitted on all items);
    windows of `width` words are joined by the hashes of template and slots, so the slots hold the
    same words. Mails are taken apart into the parts a reader sees; a window lies in one. Null and
    empty texts and texts shorter than a window have none; repeated rows give each pair once.
    """
    a, b = _both_sides(docs, items, True, 0, **options)
    return a.join(b, ["template", "slot_key"]).select("doc_id", "item_id").distinct()


def reparameterised_items(docs: DataFrame, items: DataFrame, *, least_fixed: int = 5, **options: object) -> DataFrame:
    """(doc_id, item_id, n_changed, n_same): the item's template stands there with other parameters.

    Windows of documents and items are joined by template, then their slots are checked: each slot
    word of the item must everywhere be replaced by one word, and none may serve for two.
    n_changed counts the windows whose slots hold other words, n_same those that are word for word
    (0 where nothing of the item is literal). Placeholders are decided both by the items' lexicon,
    which also knows words out of context (all in small letters, say), and by context, which knows
    words that no item uses; a window counts once. A window says something about an item only if
    `least_fixed` of its words are no placeholders: a row of numbers has the template of any other.
    """
    a, b = _both_sides(docs, items, False, least_fixed, **options)
    pairs = F.filter(F.array_distinct(F.arrays_zip("asked", "held")), lambda p: p["asked"] != 0)
    consistent = (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["asked"])))) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["held"]))))
    both = a.withColumnRenamed("slots", "held").join(b.withColumnRenamed("slots", "asked"), "template")
    windows = both.select("doc_id", "part", "pos", "item_id", "item_pos", (F.col("asked") == F.col("held")).alias("same"), consistent.alias("consistent")).distinct()
    changed, same = (F.col("consistent") & ~F.col("same")).cast("long"), F.col("same").cast("long")
    return windows.groupBy("doc_id", "item_id").agg(F.sum(changed).alias("n_changed"), F.sum(same).alias("n_same")).where("n_changed > 0")
