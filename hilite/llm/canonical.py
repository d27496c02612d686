"""One form for text that looks the same.

Texts are handled as one numpy array of code points per batch: tables map every code point to its compatibility
decomposition with look-alike letters replaced and invisible characters left out, offsets place the expansions, and
combining marks are ordered and composed for all texts at once.
"""

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Letters of other scripts and the Latin letters they look like, in the same order.
LOOK_ALIKES = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ": "ABEZHIKMNOPTYXCM",
    "αινορυϲϳ": "aivopucj",
    "АВЕЅНІЈКМОРСТУХԌԚԜѴҮӀ": "ABESHIJKMOPCTYXGQWVYI",
    "аеорсухѕіјһԁԛԝѵүӏ": "aeopcyxsijhdqwvyl",
    "օսՕՍԼ": "ouOUL",
    "ɑɡɩıℓ": "agiil",
    "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᏃ": "ABCEHJKLMPSTVZ",
}
# Hyphens that look like the ordinary one, and radicals that look like a whole character.
OTHER_ALIKES = {"‐‑−⁃": "----", "⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻤⻥⻦⻨⻩⻬⻮⻰⻳⺠⺩": "虎西见角贝车长门青韦页风飞食马鬼鱼鸟麦黄齐齿龙龟民王"}
# Characters of two kinds that look alike, in groups: Han, if there is one, then hiragana, then katakana.
KINDRED = "口ロ 卜ト 二ニ 夕タ 力カ 工エ 八ハ 一ー 丿ノ 厶ム 乂メ へヘ べベ ぺペ りリ".split()
# Ranges without any look of their own; the last line is blanks with a width, and line ends.
IGNORED = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
           (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
BLANKS, LINE_ENDS = "\u2800\u3164\uffa0", "\x0b\x0c\x85\u2028\u2029"
# Blocks in which a zero-width joiner changes what is seen: pictographs, and scripts that join letters.
JOINED = [(0x600, 0x8FF), (0x900, 0xDFF), (0x2190, 0x2BFF), (0x1F000, 0x1FAFF)]

JOINER, SIZE = 0x200D, 0x110000
CHUNK = 4_000_000


class Tables:
    """Lookup tables over all code points. alike: whether look-alike letters are replaced and invisible characters left out."""

    def __init__(self, alike: bool = True):
        self.single = np.arange(SIZE, dtype=np.int32)
        self.count = np.ones(SIZE, np.uint8)
        self.at = np.zeros(SIZE, np.int32)
        self.ccc = np.zeros(SIZE, np.uint8)
        self.joined = np.zeros(SIZE, bool)
        self.special = np.zeros(SIZE, bool)
        replace, left_out = {}, set()
        if alike:
            for pairs in (LOOK_ALIKES, OTHER_ALIKES):
                replace |= {ord(a): ord(b) for k, v in pairs.items() for a, b in zip(k, v, strict=True)}
            replace |= {ord(a): 32 for a in BLANKS} | {ord(a): 10 for a in LINE_ENDS}
            left_out = {c for a, b in IGNORED for c in range(a, b + 1)} - {JOINER}
            for a, b in JOINED:
                self.joined[a : b + 1] = True
            self.special[[13, JOINER]] = True
        expansions: list[int] = []
        pairs = {}
        for cp in (*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE1000)):
            ch = chr(cp)
            self.ccc[cp] = unicodedata.combining(ch)
            parts = [cp]
            if cp in replace:
                parts = [replace[cp]]
            elif not 0xAC00 <= cp <= 0xD7A3 and (d := unicodedata.decomposition(ch)):
                parts = [replace.get(ord(x), ord(x)) for x in unicodedata.normalize("NFKD", ch)]
                if d[0] != "<" and len(two := d.split()) == 2 and unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in two)) == ch:
                    pairs[int(two[0], 16) << 21 | int(two[1], 16)] = cp
            parts = [x for x in parts if x not in left_out]
            if parts != [cp]:
                self.count[cp] = len(parts)
                self.single[cp] = parts[0] if parts else 0
                self.at[cp] = len(expansions)
                expansions += parts if len(parts) > 1 else []
        self.expansions = np.array(expansions, np.int32)
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.composed = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        #: Characters that may compose with one before them although they aren't marks.
        self.second = np.zeros(SIZE, bool)
        self.second[[k & 0x1FFFFF for k in keys.tolist()]] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composite of each pair, 0 where there is none."""
        key = a.astype(np.int64) << 21 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = np.where(self.keys[i] == key, self.composed[i], 0)
        lead, vowel, tail, syllable = a - 0x1100, b - 0x1161, b - 0x11A7, a - 0xAC00
        out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), 0xAC00 + (lead * 21 + vowel) * 28, out)
        return np.where((syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28), a + tail, out)


@cache
def tables(alike: bool = True) -> Tables:
    return Tables(alike)


def decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the number of characters that begin before each byte (one more than bytes)."""
    first = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=before[1:])
    at = np.flatnonzero(first)
    lead = data[at].astype(np.int32)
    cp = lead.copy()
    for least, end, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        here = np.flatnonzero((lead >= least) & (lead < end))
        value = lead[here] & mask
        for k in range(1, more + 1):
            value = value << 6 | (data[at[here] + k] & 0x3F)
        cp[here] = value
    return cp, before


def encode(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and the number of bytes before each of them (one more than code points)."""
    size = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    out = np.empty(before[-1], np.uint8)
    for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        here = np.flatnonzero(size == n)
        at, value = before[here], cp[here]
        for k in range(n - 1, 0, -1):
            out[at + k] = value & 0x3F | 0x80
            value = value >> 6
        out[at] = value | mark
    return out, before


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins in them; nulls are empty."""
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if array.null_count:
        size = np.where(np.asarray(array.is_valid()), np.diff(offsets), 0)
        if size.sum() != len(data):  # bytes under a null
            return texts_of(array.fill_null(""))
    return data, offsets - offsets[0]


def to_arrow(cp: np.ndarray, starts: np.ndarray, valid: pa.Array | None) -> pa.Array:
    """A string array of the texts that begin at starts; valid: an array whose nulls are null in it as well."""
    data, before = encode(cp)
    mask = None if valid is None or not valid.null_count else pa.array(np.asarray(valid.is_valid()), pa.bool_())
    offsets = before[starts]
    if offsets[-1] < 2**31:
        kind, offsets = pa.string(), offsets.astype(np.int32)
    else:
        kind = pa.large_string()
    out = pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return out if mask is None else pa.compute.if_else(mask, out, pa.scalar(None, kind))


def kept(cp: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without the characters that aren't kept."""
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return cp[keep], before[starts]


def rows_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def canonical_points(cp: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The canonical form of texts given as code points and the places where they begin."""
    count = t.count[cp]
    if (count != 1).any():
        before = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        out = np.empty(before[-1], np.int32)
        here = np.flatnonzero(count > 0)
        out[before[here]] = t.single[cp[here]]
        many = np.flatnonzero(count > 1)
        for k in range(1, int(count.max(initial=0))):
            many = many[count[many] > k]
            out[before[many] + k] = t.expansions[t.at[cp[many]] + k]
        cp, starts = out, before[starts]
    else:
        cp = t.single[cp]
    if t.special[cp].any():
        row = rows_of(starts)
        same = np.append(row[1:] == row[:-1], False)  # as the next
        drop = (cp == 13) & same & (np.append(cp[1:], 0) == 10)
        joiner = cp == JOINER
        other = np.flatnonzero(~joiner)
        where = np.flatnonzero(joiner)
        i = np.searchsorted(other, where)
        left, right = other[np.maximum(i - 1, 0)] if len(other) else where, other[np.minimum(i, len(other) - 1)] if len(other) else where
        fits = (i > 0) & (i < len(other)) if len(other) else np.zeros(len(where), bool)
        tone = lambda x: t.joined[cp[x]] | ((cp[x] >= 0x1F3FB) & (cp[x] <= 0x1F3FF))
        fits = fits & (row[left] == row[where]) & (row[right] == row[where]) & tone(left) & tone(right) & (np.append(-1, cp[:-1])[where] != JOINER)
        drop[where[~fits]] = True
        cp, starts = kept(cp, starts, ~drop)
    ccc = t.ccc[cp]
    follows = (ccc > 0) | t.second[cp]
    begins = np.zeros(len(cp) + 1, bool)
    begins[starts] = True
    begins = begins[:-1]
    if not (follows & ~begins).any():
        return cp, starts
    ahead = (ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & ~begins[1:]
    if ahead.any():
        order = np.lexsort((ccc, np.cumsum((ccc == 0) | begins)))
        cp, ccc = cp[order], ccc[order]
        follows = (ccc > 0) | t.second[cp]
    run = np.cumsum(~follows | begins) - 1
    base = np.flatnonzero(~follows | begins)
    rank = np.arange(len(cp)) - base[run]
    marks = np.flatnonzero(rank > 0)
    marks = marks[np.argsort(rank[marks], kind="stable")]
    last = np.zeros(len(base), np.uint8)
    keep = np.ones(len(cp), bool)
    cp = cp.copy()
    for e in np.split(marks, np.flatnonzero(np.diff(rank[marks])) + 1):
        r, c = run[e], ccc[e]
        b = base[r]
        new = t.compose(cp[b], cp[e])
        fits = (new > 0) & (ccc[b] == 0) & ((last[r] < c) | ((last[r] == 0) & (c == 0)))
        cp[b[fits]] = new[fits]
        keep[e[fits]] = False
        last[r[~fits]] = c[~fits]
        alone = ~fits & (c == 0)
        base[r[alone]] = e[alone]
    return kept(cp, starts, keep)


def chunks(array: pa.Array, size: int = CHUNK):
    """Slices of a string array of about size bytes; a longer text is one slice."""
    if array.nbytes <= size:
        yield array
        return
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0), np.int64))
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield array.slice(i, j - i)
        i = j


def canonical_array(array: pa.Array, alike: bool = True, then=None) -> pa.Array:
    """The canonical form of each text of a string array; then: what is done to its code points, given with the places where texts begin."""
    out = []
    for part in chunks(array):
        data, offsets = texts_of(part)
        if not len(data):
            out.append(part)
            continue
        cp, before = decode(data)
        cp, starts = canonical_points(cp, before[offsets], tables(alike))
        out.append(to_arrow(then(cp, starts) if then else cp, starts, part))
    return pa.concat_arrays([x.cast(pa.string()) for x in out]) if out else array


OTHER, HAN, HIRAGANA, KATAKANA = range(4)


@cache
def kindred() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: the first of its group, its kind, whether it is in a group, and the member of each kind in it, 0 where there is none."""
    first, kind, grouped = np.arange(SIZE, dtype=np.int32), np.zeros(SIZE, np.uint8), np.zeros(SIZE, bool)
    for a, b, k in ((0x3005, 0x3007, HAN), (0x3041, 0x309F, HIRAGANA), (0x30A1, 0x30FA, KATAKANA), (0x30FC, 0x30FF, KATAKANA), (0x31F0, 0x31FF, KATAKANA), (0x3400, 0x9FFF, HAN), (0xF900, 0xFAFF, HAN), (0x20000, 0x323AF, HAN)):
        kind[a : b + 1] = k
    member = np.zeros((4, SIZE), np.int32)
    for group in KINDRED:
        for c in map(ord, group):
            first[c], grouped[c] = ord(group[0]), True
            member[kind[[*map(ord, group)]], c] = [*map(ord, group)]
    return first, kind, grouped, member


def looks_array(array: pa.Array) -> pa.Array:
    """The form of each text of a string array in which equal looks are equal strings."""
    return canonical_array(array, then=lambda cp, starts: kindred()[0][cp])


def in_context(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Canonical texts with characters that look like one of another kind read as the kind around them.

    A stretch of such characters is read as what is beside it: a Han character is kana beside katakana, with no Han
    character beside the stretch, or in a stretch with katakana; a single katakana character is Han between two Han
    characters; hiragana and katakana become each other beside the other one alone. All else keeps its kind: with Han
    on one side and kana on the other, both readings are real words.
    """
    _, kinds, grouped, member = kindred()
    among = grouped[cp]
    if not among.any():
        return cp
    row = rows_of(starts)
    new = np.append(True, row[1:] != row[:-1])
    begin = np.flatnonzero(among & (new | ~np.append(False, among[:-1])))
    end = np.flatnonzero(among & np.append(new[1:] | ~among[1:], True)) + 1
    kind = kinds[cp]
    left = np.where(new[begin], OTHER, kind[begin - 1])
    right = np.where(np.append(new, True)[end], OTHER, np.append(kind, OTHER)[end])
    at = np.flatnonzero(among)
    run = np.repeat(np.arange(len(begin)), end - begin)
    own = kind[at]
    beside = lambda k: (left == k) | (right == k)
    mixed = np.zeros(len(begin), bool)
    mixed[run[own == KATAKANA]] = True
    to_kana = ~beside(HAN) & (beside(KATAKANA) | mixed)
    to_katakana = beside(KATAKANA) & ~beside(HAN) & ~beside(HIRAGANA)
    to_hiragana = beside(HIRAGANA) & ~beside(HAN) & ~beside(KATAKANA)
    to_han = (left == HAN) & (right == HAN) & (end - begin == 1)
    out = cp.copy()
    for source, target, where in ((HAN, KATAKANA, to_kana), (KATAKANA, HAN, to_han), (HIRAGANA, KATAKANA, to_katakana), (KATAKANA, HIRAGANA, to_hiragana)):
        here = at[(own == source) & where[run]]
        here = here[member[target, cp[here]] > 0]
        out[here] = member[target, cp[here]]
    return out


@arrow_udf(StringType())
def _canonical(text: pa.Array) -> pa.Array:
    return canonical_array(text)


@arrow_udf(StringType())
def _looks(text: pa.Array) -> pa.Array:
    return looks_array(text)


@arrow_udf(StringType())
def _read(text: pa.Array) -> pa.Array:
    return canonical_array(text, then=in_context)


def canonical(text: Column) -> Column:
    """text in the one form in which equal looks mean equal strings.

    Full-width, half-width and compatibility forms become the ordinary character, look-alike letters of other scripts
    Latin ones, accents are composed with their letter, blanks of any width become a blank each, and invisible
    characters go; a zero-width joiner stays where it changes what is seen. Letter case, visible accents and the
    number of blanks remain. Null stays null, an empty text or one of invisible characters only is empty.
    """
    return _canonical(text)


def looks(text: Column) -> Column:
    """text in canonical form with Han, hiragana and katakana that look alike (口 and ロ, へ and ヘ) as one character: for comparison, not for display."""
    return _looks(text)


def read_in_context(text: Column) -> Column:
    """text in canonical form with each of these characters as the kind of letter that is around it; see in_context."""
    return _read(text)


def same_looks(df: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Rows of df whose whole text looks like a phrase but isn't equal to it, with the columns of the phrase.

    Spark broadcasts phrases if they are small enough for its threshold and shuffles both sides otherwise. A phrase
    that is there twice gives a row each; null texts and phrases match nothing. Columns of phrases with a name that df
    has as well get ``_phrase`` behind it.
    """
    left = df.where(F.col(text).isNotNull()).withColumns({"__form": looks(F.col(text)), "__text": F.col(text)})
    named = [F.col(c).alias(f"{c}_phrase" if c in df.columns else c) for c in phrases.columns]
    right = phrases.where(F.col(phrase).isNotNull()).select(*named, looks(F.col(phrase)).alias("__like"), F.col(phrase).alias("__phrase"))
    return left.join(right, (F.col("__form") == F.col("__like")) & (F.col("__text") != F.col("__phrase"))).drop("__form", "__text", "__like", "__phrase")
