"""Sentence units of texts in any script.

Boundaries are found from the characters' sentence-break properties (terminators of all scripts, closers, what may follow), then corrected
for what the properties cannot know: abbreviations by language, initials, ordinals and enumerations, quotations that hold sentences,
brackets, line breaks that only wrap, lines that are a unit by themselves, and scripts that end sentences with a space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Abbreviations after which a sentence goes on, whatever follows (lower case, without the last period).
NEVER_LAST = frozenset(
    # English
    "dr mr mrs ms prof st capt col gen lt sgt rev hon no nos fig figs vol ed eds approx vs cf para paras sec ch pp p al sat sun mon tue wed thu fri jan feb mar apr jun jul aug sep sept oct nov dec i.e e.g viz ref"
    # German
    " nr abs art bd bzw ca vgl str hr fr hrn ff evtl ggf sog z.b d.h u.a jh tel"
    # French, Spanish
    " mme mlle mm m al env n num núm aprox sr sra srta dña ee oo uu p.ej ej pág tel"
    # Russian
    " ул рис табл тыс см стр им проф акад т.е т.к т.н г-н г-жа млн млрд"
    # Hindi
    " डॉ सं श्री मि ग्रा मि.ग्रा कि.ग्रा रु प्रो"
    # Thai
    " มก กก ซม กม พ.ศ ค.ศ ดร".split()
)
# Words shortened in names of organisations: a sentence ends there only before a word that opens sentences.
NAME_PARTS = frozenset("univ hosp assoc assn soc found fdn inst lab dept ctr cncl med fin sys chem publ appl bot hist nutr res transp eng intl nat natl tech sci dev mgmt stud agric phys opt acad vet ins".split())
STARTERS = frozenset(
    "the a an it he she we you they i our his her its this that these those there here did does do what who when where how why no not all if as but and so then now yet one some any"
    " das der die ein eine es er sie wir man und wo wer was wie il elle on nous vous le la les un une est ce où qui el los las una uno qué quién cómo dónde".split()
)
# Abbreviations that end a sentence if what follows can begin one.
MAYBE_LAST = frozenset("a.m p.m etc inc ltd co corp jr sr s.a bros dep usw usf руб коп т.д т.п др ст ทบ น esq plc llc gmbh".split())
SUFFIXES = frozenset("limited incorporated inc ltd co corp s.a bros gmbh plc llc".split())
# Words that do not begin a sentence after an abbreviation.
GOES_ON = frozenset(
    "and or but are is was were has have of for in on by to from with"
    " und oder aber hat ist sind liegt war"
    " et ou en a est sont de du y e o u por con que la"
    " и или но".split()
)
# Words after which a number with a period is an ordinal.
ORDINAL_BEFORE = frozenset("der die das den dem des am im vom zum zur beim ab bis seit".split())
# Thai words that begin sentences in any text: pronouns and titles. Others are counted.
THAI_OPENS = tuple("คุณ เขา เธอ ฉัน ผม เรา นาย นาง ท่าน".split())
# Words of measure, prepositions and titles, which want a word after them.
THAI_WANTS = tuple("คุณ นาย นาง นางสาว ดร. ที่ ไป จาก กับ ของ โดย ถึง ให้ เป็น คือ และ หรือ ใน บน ต่อ เวลา ขนาด จำนวน ประมาณ หมายเลข อายุ ราคา เงิน วันที่".split())
#: Share of the certain beginnings of Thai sentences that start alike from which on such a start counts as one, and least number of them.
OPENS_SHARE, OPENS_LEAST, OPENS_CHARS = 0.004, 4, 3
#: Characters of Thai without a space that may be a single word; more are a clause.
SHORT_WORD = 8
THAI_JOINS = tuple("และ หรือ แต่ ที่ ซึ่ง เพราะ ๆ โดย".split())

# Evidence of wrapped lines from which on single line breaks of a text are white space.
WRAPS = 2

_CLOSER_OF = {"„": "“”", "“": "”", "«": "»", "»": "«", "「": "」", "『": "』", '"': '"', "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
_BRACKETS = "(（[【"
_TERM = r"[\p{STerm}.…．｡]"
_CANDIDATE = regex.compile(rf"{_TERM}+(?:\s{{1,2}}{_TERM}(?=\s|$))*|[\p{{Ps}}\p{{Pe}}\p{{Pi}}\p{{Pf}}\"]", regex.V1)
_STRONG_THEN_DOTS = regex.compile(r"([。！？｡]+)(?:\.{3,}|…+)")
_LAST_SCRIPT = regex.compile(r"[^\p{Han}\p{Hiragana}\p{Katakana}]*$", regex.V1)
_SPACES = regex.compile(r"\s*")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’-]|\.(?=[\p{L}\p{M}]))*$", regex.V1)
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’-]*", regex.V1)
_LIST_ITEM = regex.compile(r"\s*(?:[-*•‣◦–]\s+\S|\(?\d{1,3}[.)]\s+\S)")
_FIELD = regex.compile(r"\s*[\p{Lu}\p{Lt}\p{Lo}\p{Ll}][\p{L}\p{M}\p{N}_ \t  ]{0,30}\s*[:=]\s*[^\s/].*")
_SENTENCE_LIKE = regex.compile(r"[.!?。！？।؟…][\"”»’)\]）」』]*\s*$")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]", regex.V1)
_THAI = regex.compile(r"\p{Thai}", regex.V1)
_LETTER = regex.compile(r"\p{L}")
_LINES = regex.compile(r"[^\r\n  \u0085]+")
_TOKENS = regex.compile(r"\S+")
_ONE_LINE_RECORD = regex.compile(r"\s*(?:\{.*\}|\[.*\]|[^|=:]{1,40}[=:][^|]*(?:\|[^|=:]{1,40}[=:][^|]*)+)\s*", regex.S)


def units(text: str, openers: tuple[str, ...] = THAI_OPENS) -> list[tuple[int, int]]:
    """Half-open code-point spans of the sentence units of a text: they cover all of it but white space."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    if text.lstrip()[0] in "{[" or "|" in text:
        if _ONE_LINE_RECORD.fullmatch(text):
            return [_stripped(text, 0, len(text))]
    for a, b, whole in _segments(text):
        if whole:
            out.append(_stripped(text, a, b))
        else:
            out += _sentences(text, a, b, openers)
    return out


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


# --- lines ------------------------------------------------------------------------------------------------------------------------


def _segments(text: str) -> list[tuple[int, int, bool]]:
    """Stretches to look for sentences in, and lines that are a unit by themselves (True)."""
    lines = [(m.start(), m.end()) for m in _LINES.finditer(text) if not m[0].isspace()]
    if len(lines) < 2:
        return [(a, b, _alone(text[a:b]) == 2) for a, b in lines]
    kinds, wraps = [], 0
    for i, (a, b) in enumerate(lines):
        line = text[a:b]
        gap_before = i == 0 or _blank_between(text, lines[i - 1][1], a)
        gap_after = i + 1 == len(lines) or _blank_between(text, b, lines[i + 1][0])
        kind = _alone(line)
        if kind == 1 and line.lstrip()[:1].isdigit() and not gap_before and not (kinds[-1][0] or kinds[-1][3]):
            kind = 0
        ends = bool(_SENTENCE_LIKE.search(line)) and not _open_end(line)
        kinds.append((kind, gap_before, gap_after, ends, line))
    for i, (kind, before, after, ends, line) in enumerate(kinds):
        if not kind and not after and not ends and not kinds[i + 1][0] and not (before and _titled(line, kinds[i + 1][4])):
            wraps += 2 if kinds[i + 1][4].lstrip()[:1].islower() or _open_end(line) else 1
    out: list[tuple[int, int, bool]] = []
    start = None
    for i, ((a, b), (kind, before, after, ends, line)) in enumerate(zip(lines, kinds)):
        head = not kind and not ends and before and len(line) <= 60 and (i + 1 == len(lines) or after or _titled(line, kinds[i + 1][4])) and (i > 0 or not after) and len(line.split()) <= 8 and not _THAI.search(line)
        if kind or head:
            if start is not None:
                out.append((start, lines[i - 1][1], False))
                start = None
            out.append((a, b, True))
            continue
        if start is not None and (before or wraps < WRAPS):
            out.append((start, lines[i - 1][1], False))
            start = None
        if start is None:
            start = a
    if start is not None:
        out.append((start, lines[-1][1], False))
    return out


def _open_end(line: str) -> bool:
    """A line that ends in a comma, a dash, an initial or a short word that wants something after it."""
    bare = line.rstrip()
    last = bare.split()[-1] if bare else ""
    return bare[-1:] in ",;:-–—（(" or last.isalpha() and last.islower() and len(last) <= 3 or bool(regex.fullmatch(r"\p{Lu}\.", last))


def _blank_between(text: str, a: int, b: int) -> bool:
    gap = text[a:b].replace("\r\n", "\n")
    return gap.count("\n") + gap.count("\r") + gap.count(" ") > 1


def _alone(line: str) -> int:
    """1 for a list item or form field, 2 for an unbroken run of characters, else 0."""
    bare = line.strip()
    if _LIST_ITEM.match(line):
        return 1
    if len(bare) >= 40 and not any(c.isspace() for c in bare) and not _THAI.search(bare) and not _CJK.search(bare):
        return 2
    if _FIELD.fullmatch(line):
        key = regex.split(r"[:=]", line, maxsplit=1)[0].split()
        value = regex.split(r"[:=]", line, maxsplit=1)[1].lstrip()
        if len(key) <= 3 and value[:1] not in "\"“”„«»「'" and not regex.search(r"[!?।。]|\.\s+\p{Lu}\p{Ll}+\s+\p{Ll}", line):
            return 1
    return 0


def _titled(line: str, following: str) -> bool:
    """Whether a short line before another one reads as a heading and not as the start of a wrapped sentence."""
    words = line.split()
    if len(words) > 8 or len(line) > 60 or _open_end(line):
        return False
    return not _small(following.lstrip(), 0) or line.strip().islower()


# --- sentences ----------------------------------------------------------------------------------------------------------------------


def _sentences(text: str, lo: int, hi: int, openers: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    seg = text[lo:hi]
    cuts: list[int] = []
    begin = _SPACES.match(seg).end()
    stack: list[tuple[str, int]] = []
    mixed = any(c.islower() for c in seg) and any(c.isupper() for c in seg)
    n = len(seg)
    pos = 0
    while m := _CANDIDATE.search(seg, pos):
        i, pos = m.start(), m.end()
        c = seg[i]
        if c in _CLOSER_OF or c in "”“»«」』)）]】》〉":
            if stack and c in _CLOSER_OF.get(stack[-1][0], ""):
                opened, at = stack.pop()
                if stack:
                    continue
                inner = seg[at + 1 : i].rstrip()
                after = _SPACES.match(seg, pos).end()
                if inner and regex.match(_TERM, inner[-1]) and after < n:
                    first = at == begin
                    if opened in _BRACKETS:
                        if first and (_can_begin(seg, after, pos < after) or seg[after].islower()):
                            cuts.append(pos)
                            begin = after
                    elif not first and _can_begin(seg, after, pos < after) and not _attributed(seg, after) and not _goes_on(seg, after):
                        cuts.append(pos)
                        begin = after
            elif c in _CLOSER_OF and any(seg.find(k, pos) >= 0 for k in _CLOSER_OF[c]) and not (c == '"' and i and seg[i - 1].isalnum()):
                stack.append((c, i))
            continue
        if stack:
            continue
        split = _STRONG_THEN_DOTS.fullmatch(m[0])
        if split and pos < n and seg[pos].isalpha():
            # a sentence that begins with dots follows at once
            cuts.append(i + len(split[1]))
            begin = cuts[-1]
            continue
        # closers that belong to no opener stay with the sentence
        while pos < n and seg[pos] in "\"'”’»)]）」』" and (pos + 1 == n or seg[pos + 1].isspace()):
            pos += 1
        after = _SPACES.match(seg, pos).end()
        if after >= n:
            break
        if _breaks(seg, i, m.end(), pos, after, begin, mixed, openers):
            cuts.append(pos)
            begin = after
    for a, b in zip([0, *cuts], [*cuts, n]):
        a, b = _stripped(seg, a, b)
        if a < b:
            if _THAI.search(seg, a, b):
                yield from ((lo + x, lo + y) for x, y in _thai(seg, a, b, openers))
            else:
                yield lo + a, lo + b


def _can_begin(seg: str, at: int, spaced: bool) -> bool:
    """Whether a sentence can begin here, after a closed quotation or bracket."""
    c = seg[at]
    if c in "—–":
        return bool(regex.match(r"[—–]\s?[¿¡]", seg[at : at + 3]))
    if regex.match(r"[\p{Pd},;:，、；：؛،\p{Pe}\p{Pf}]", c) and c not in "»":
        return False
    if regex.match(_TERM, c):
        return seg.startswith("...", at) and spaced or c == "…" and spaced
    if _small(seg, at):
        return not spaced or not any(x.isupper() for x in seg)
    return True


def _attributed(seg: str, at: int) -> bool:
    """Particles that tie a quotation to the words after it."""
    return seg[at] in "とっ" or seg.startswith(("って", "라고"), at)


def _may_break(seg: str, i: int, end: int, pos: int, after: int) -> bool:
    """The default sentence-break rules by character properties, for terminators seg[i:end], closers up to pos and spaces up to after.

    No break before a mark that continues a sentence or another terminator, save dots that open one; none within a number or between
    capitals. The rule for small letters after a full stop is applied below, to abbreviations, initials and numbers only: people also begin
    sentences with small letters, and a word that is none of these ends a sentence before them too.
    """
    opens = after > pos and (seg.startswith("...", after) or seg[after] == "…")
    if _CONTINUES.match(seg, after) and not opens:
        return False
    if any(_STERM.match(c) for c in seg[i:end]) or pos > end or after > pos:
        return True
    return not (_NUMERIC.match(seg, after) or i and _CASED.match(seg[i - 1]) and _UPPER.match(seg, after))


_CONTINUES = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}--\p{Pd}]", regex.V1)
_STERM = regex.compile(r"\p{SB=STerm}")
_NUMERIC = regex.compile(r"\p{SB=Numeric}")
_UPPER = regex.compile(r"\p{SB=Upper}")
_CASED = regex.compile(r"[\p{SB=Upper}\p{SB=Lower}]", regex.V1)


def _breaks(seg: str, i: int, end: int, pos: int, after: int, begin: int, mixed: bool, openers: tuple[str, ...]) -> bool:
    if not _may_break(seg, i, end, pos, after):
        return False
    mark = seg[i:end]
    spaced = after > pos
    nxt = seg[after]
    if regex.match(r"[;，、；：؛،\p{Pe}]", nxt):
        return False
    strong = any(c not in ".…．" for c in mark)
    if strong and nxt in "—–" and seg[begin] in "—–«»\"“„":
        # speech, then a dash and who said it
        return False
    if strong:
        if seg[begin] in "'‘" and "'" in seg[end:pos] or "’" in seg[end:pos] and seg[begin] == "‘":
            return False
        if _small(seg, after) and _goes_on(seg, after):
            return False
        return spaced or bool(_CJK.search(seg[max(0, i - 1) : i + 1])) or mark[-1] in "。！？｡।॥؟"
    dots = mark.count(".") + 3 * mark.count("…")
    spread = any(c.isspace() for c in mark)
    if not spaced:
        return False
    word = _WORD_BEFORE.search(seg, max(begin, i - 24), i)
    w = _LAST_SCRIPT.search(word[0])[0].lower() if word else ""
    if dots >= 3 and not spread:
        if i == begin:
            return False
        count = len(seg[begin:i].split())
        if count <= 1 and not _CJK.search(seg[begin:i]) and not _LETTER.search(nxt) is None and _caseful(nxt):
            return False
        return not (mixed and _small(seg, after)) or count >= 2 and not _goes_on(seg, after)
    if dots == 2 or spread:
        return True
    if not w:
        return not _small(seg, after) or bool(regex.match(r"[\p{Pe}\p{Pf}\"]", seg[i - 1 : i]))
    if w.isdigit():
        return _after_number(seg, i, after, begin, w, mixed)
    stem = w.replace("-", "")
    parts = w.split(".")
    if len(parts[-1]) == 1 and _LETTER.match(parts[-1]) and not (len(parts) > 1 and (w in MAYBE_LAST or w in NEVER_LAST)):
        pair = _pair_before(seg, word.start(), begin, w)
        if pair in MAYBE_LAST:
            return not _goes_on(seg, after) and (not mixed or not _small(seg, after))
        if w == "น":
            return True
        if word[0].islower() and seg[: word.start()].rstrip()[-1:].isdigit():
            # a unit after a number
            return not nxt.isdigit() and not _goes_on(seg, after) and not (mixed and _small(seg, after))
        return False
    if w == "no":
        return not nxt.isdigit()
    if w in MAYBE_LAST or len(parts) > 1 and len(parts[-1]) <= 2 and w not in NEVER_LAST:
        if _THAI.match(nxt):
            return seg.startswith(openers, after)
        if w in SUFFIXES:
            word_after = _NEXT_WORD.match(seg, after)
            if nxt.isalpha() and not _caseful(nxt) or word_after and word_after[0].lower() in SUFFIXES:
                return False
        return not _goes_on(seg, after) and (not mixed or not _small(seg, after))
    if w in NAME_PARTS and nxt.isupper() and mixed:
        m = _NEXT_WORD.match(seg, after)
        return bool(m) and m[0].lower() in STARTERS
    return w not in NEVER_LAST and stem not in NEVER_LAST and w not in NAME_PARTS


def _caseful(c: str) -> bool:
    return c.islower() or c.isupper()


def _goes_on(seg: str, at: int) -> bool:
    """Whether the next word is one that does not begin a sentence; capitalised, it may, unless the words after it are capitalised too."""
    m = _NEXT_WORD.match(seg, at)
    if not m or m[0].lower() not in GOES_ON or seg.startswith(".", m.end()):
        return False
    return not (m[0][0].isupper() and regex.match(r"\p{Ll}*\s+\p{Ll}", seg[at + 1 :])) if len(m[0]) > 1 else True


def _small(seg: str, at: int) -> bool:
    """Whether a word in small letters stands here, other than one like e-mail that is never written otherwise."""
    return seg[at].islower() and not regex.match(r"\p{Ll}(?:-\p{L}|\p{Lu})", seg[at : at + 3])


def _pair_before(seg: str, at: int, begin: int, w: str) -> str:
    """The last two parts of an abbreviation written with spaces, as in 'т. д.'"""
    m = regex.search(r"(?<!\p{L})(\p{L})\.\s*$", seg[max(begin, at - 5) : at])
    return f"{m[1].lower()}.{w}" if m else ""


def _after_number(seg: str, i: int, after: int, begin: int, w: str, mixed: bool) -> bool:
    if _small(seg, after) and mixed:
        # numbers of an enumeration and ordinals stand before small letters; a sentence may still end in a number
        return not (_enumerates(seg, i, w, begin) or _ordinal(seg, i, w))
    if _ordinal(seg, i, w) or _enumerates(seg, i, w, begin):
        return False
    return True


def _ordinal(seg: str, i: int, w: str) -> bool:
    before = seg[: i - len(w)].rstrip()
    m = regex.search(r"\p{L}+$", before[-12:])
    return bool(m) and m[0].lower() in ORDINAL_BEFORE


def _enumerates(seg: str, i: int, w: str, begin: int) -> bool:
    """Whether the number is one of a run such as 1. this, 2. that."""
    if len(w) > 2:
        return False
    k = int(w)
    between = r"\.\s+(?:[\p{L}\p{M}-]+[,;]?\s+){1,4}"
    if regex.match(rf"{between}{k + 1}\.\s", seg[i : i + 60]):
        return True
    return k > 1 and bool(regex.search(rf"(?<!\d){k - 1}{between}{k}$", seg[max(begin, i - 60) : i]))


# --- a script that ends sentences with a space ------------------------------------------------------------------------------------------


def _thai(seg: str, a: int, b: int, openers: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    tokens = [(m.start(), m.end()) for m in _TOKENS.finditer(seg, a, b)]
    words = [seg[x:y] for x, y in tokens]
    first = 0
    quoted = False
    for k in range(len(tokens) - 1):
        x = words[k]
        quoted = (quoted or any(c in x for c in "“「«")) and not any(c in x for c in "”」»")
        if not quoted and _thai_break(x, words[k + 1], k == first, openers):
            yield tokens[first][0], tokens[k][1]
            first = k + 1
    yield tokens[first][0], tokens[-1][1]


def _thai_break(x: str, y: str, alone: bool, openers: tuple[str, ...]) -> bool:
    """Whether a sentence ends between two words; alone says that it has no other word than x yet.

    A space between two Thai words ends it. Words of other scripts and numbers stand in spaces of their own: after one a sentence ends only
    before a word that opens sentences, and before one only if what was said so far is more than a word and wants nothing after it.
    """
    thai_x, thai_y = bool(_THAI.match(x[-1])) or bool(_THAI.search(x)) and x[-1] == ".", bool(_THAI.match(y[0]))
    if x[-1] in "”\"»」" or not any(c.isalnum() for c in y):
        return False
    if y[0] in "“\"«「":
        return x[-1] not in ":,;" and not x.endswith("ว่า") and not x.endswith(THAI_WANTS)
    if thai_x and thai_y:
        if x[-1] == ".":
            return x == "น."
        return not y.startswith(THAI_JOINS) and x not in THAI_WANTS
    if thai_y:
        return y.startswith(openers)
    if thai_x:
        return x == "น." or x[-1] != "." and not (alone and len(x) <= SHORT_WORD) and not x.endswith(THAI_WANTS) and not y[0].isdigit()
    return False


def thai_starts(text: str) -> list[str]:
    """How the certain Thai sentences of a text begin: those at its start or the start of a line, or after a space between Thai words."""
    if not _THAI.search(text):
        return []
    out = []
    for m in _LINES.finditer(text):
        words = m[0].split()
        for k, w in enumerate(words):
            if _THAI.match(w[0]) and (k == 0 or _THAI.match(words[k - 1][-1]) and words[k - 1] not in THAI_WANTS and not w.startswith(THAI_JOINS)):
                out.append(w[:OPENS_CHARS])
    return out


# --- tables -------------------------------------------------------------------------------------------------------------------------


def sentence_units(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, unit_no, start_char, end_char) of every sentence unit of every row, over whole texts and without a shuffle.

    Defined cases: null and blank texts have no units; a text without any terminator is one unit (a line each where lines stand alone);
    very long runs without spaces are one unit; offsets count code points; other columns are ignored. Thai texts are read twice: their
    sentences have no marks, so how they begin is counted over all of them first.
    """

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    openers = thai_openers(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, spans = b.column(0), [], []
            for t in b.column(1):
                u = units(t.as_py() or "", openers)
                lengths.append(len(u))
                spans += u
            n = np.array(lengths, "int64")
            s = np.array(spans, "int32").reshape(-1, 2)
            of = np.repeat(np.arange(len(n)), n)
            first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array((np.arange(len(s)) - first[of]).astype("int32")), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=["id", "unit_no", "start_char", "end_char"])

    return rows.mapInArrow(run, "id long, unit_no int, start_char int, end_char int")


def thai_openers(df: DataFrame, text: str) -> tuple[str, ...]:
    """Beginnings of Thai sentences: those of any text, and those that are common at the certain beginnings in all texts of df.

    Counted in the tasks; the driver gets beginnings of a few characters that reach a fixed share, so at most 1 / OPENS_SHARE of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(x for t in b.column(0) for x in thai_starts(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["start", "n"])

    starts = df.select(F.col(text)).where(F.col(text).rlike(r"\p{IsThai}")).mapInArrow(count, "start string, n long").groupBy("start").agg(F.sum("n").alias("n"))
    share = starts.select("start", "n", F.sum("n").over(Window.partitionBy()).alias("all")).where((F.col("n") >= OPENS_LEAST) & (F.col("n") >= OPENS_SHARE * F.col("all")))
    return THAI_OPENS + tuple(sorted(r["start"] for r in share.select("start").collect()))
