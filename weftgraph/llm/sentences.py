"""Sentence boundaries in any script by a pushdown automaton.

The automaton reads a text once. Its stack holds open quotations and brackets; its line
state tells list items, log lines and headings from prose, so that marks inside a nested
level never end the sentence around it. Terminators are judged by script, by what was
closed with them, by the abbreviation trie and by what follows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# ---------------------------------------------------------------- fixed values

#: Abbreviations that something always follows, so they end no sentence.
LEADING = """
dr mr mrs ms prof rev hon gen col capt lt sgt st mt fr hr hrn sr sra srta dña d mme mlle mgr
no nos nr nrn num núm nº fig figs sec secs ch chap vol vols pp p pg pág págs art arts abb abs abschn kap bd s
rev ext dept approx max min est e.g i.e eg ie cf vs viz al ca cca bzw vgl z.b d.h u.a u.ä i.d.r zzgl inkl exkl ggf evtl sog geb gest tel
p.ej ej p.ex ex aprox env réf ref av apr tlf admón
т.е т.к т.н им стр рис гл г-н г-жа см напр ул д.р др.проф проф акад
د أ م डॉ श्री प्रो
""".split()
#: Abbreviations that may also end a sentence; they do where a new one begins.
TRAILING = """
etc usw usf inc ltd co corp bros llc plc u.s u.k u.s.a u.n e.u a.m p.m hrs std min mins sek jr
ud uds s.a s.l cía s.a.r.l т.д т.п др мес шт ч мин сек тыс млн млрд руб коп г гг в.в вв кг см ул
""".split()
COMPANY = set("inc ltd co corp bros llc plc gmbh".split())
#: Months, before which a number with a dot is a day.
MONTHS = set("""
januar jänner februar märz april mai juni juli august september oktober november dezember
january february march may june july october december
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janvier février mars avril juin juillet août septembre octobre novembre décembre
gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre
janeiro fevereiro março maio junho julho setembro outubro novembro dezembro
januari februari maart mei augustus marts maj
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
""".split())
#: Months cut short; a day or a year follows them within the sentence.
SHORT_MONTHS = """
jan feb mar apr jun jul aug sep sept oct nov dec jän mrz okt dez
ene abr ago set dic janv févr avr juil déc gen mag giu lug ott fev mai out maa mei
янв фев февр мар апр июн июл авг сен сент окт ноя нояб дек
""".split()
#: Words that begin sentences far more often than they are names.
OPENERS = set("""
the a an this that these those it he she they we you i there then here if when while after before but and so no what why how in on at for from as all
der die das ein eine er sie es wir ihr ich dies diese dieser dann danach dort hier wenn als aber und
el la los las un una él ella ellos se esto esta este luego después si cuando pero y
le les une il elle ils elles nous vous je ce cette ces puis ensuite quand mais et
он она оно они мы вы я это этот эта эти затем потом если когда но и в на
""".split())
#: Symbols of units of one capital letter: volt, ampere, watt, coulomb, litre, kelvin, newton, joule, mega.
UNIT_SYMBOLS = set("VAWCLKNJM")

#: A line is a title up to this many characters.
TITLE_CHARS = 60
#: A bracket from this many characters on may be a sentence that ends the one before it.
ASIDE_CHARS = 20
#: Lines of this many characters or more are wrapped prose; one that stays under this share of the widest line of its
#: block (of hard-wrapped width) although the next word had room was ended on purpose.
WRAPPED_CHARS, WRAPPED_SHARE, WRAPPED_WIDTH = 25, 0.7, 100

PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】", "{": "}", '"': '"', "‘": "’", "＂": "＂"}
CLOSING = set("”»›」』》〉)）]】}\"“’＂")
INVISIBLE = set("​‌‍⁠﻿­᠎")

# ---------------------------------------------------------------- abbreviation trie


def _trie(words: list[str], mark: str, root: dict) -> dict:
    """Words from their last letter to the first, since the automaton looks back from the dot."""
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node.setdefault("", mark)
    return root


TRIE = _trie(TRAILING, "trailing", {})
_trie([w for w in LEADING if w not in TRAILING], "leading", TRIE)
_trie(SHORT_MONTHS, "month", TRIE)


_DOTTED_MONTH = re.compile(rf"(?:{'|'.join(SHORT_MONTHS)})\.", re.I)


def _lookup(word: str) -> str | None:
    node = TRIE
    for c in reversed(word):
        node = node.get(c)
        if node is None:
            return None
    return node.get("")


# ---------------------------------------------------------------- lines

_MARKER = re.compile(r"[ \t  ]*(?:[-*•‣◦▪·–—+]|\d{1,3}[.)]|\(?[A-Za-z]\)|\(\d{1,3}\)|\(?[ivx]{1,5}\)|[①-⑳])[ \t  ]+\S")
_LOG = re.compile(r"[ \t]*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?\]?(?:Z|[+-]\d\d:?\d\d)?[ \t]+\S*.*\w+=\S|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?\]?[ \t]+(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|(?:\S+=\S+[ \t]+){2,}\S+=\S+)")
_DUMP = re.compile(r"[ \t]*(?:[0-9A-Fa-f]{32,}|[A-Za-z0-9+/=_]{60,})[ \t]*$")
_EMPTY = re.compile(r"\n[^\S\n]*(?=\n)")

#: Unicode's sentence terminals but for the Burmese comma, and marks that stand in for them in East Asia and Greece.
_TERMINATORS = "".join(c for c in regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, range(0x20000)))) if c not in "၊․") + "…｡．\u037e"
_STRONG = set("!?؟۔！？‼‽⁇⁈⁉⸮;\u037e")
#: Marks that end a sentence whatever follows: those of scripts that have a full stop of their own.
_WIDE = set(_TERMINATORS) - set(".…．؟۔!?‼‽⁇⁈⁉⸮\u037e")
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
_ENDS = frozenset(_TERMINATORS)
# characters past U+FFFF stand apart: in one class with the others they make it slow
_END = re.escape("".join(c for c in _TERMINATORS if c < "\U00010000"))
_EVENT = re.compile(rf"[{_END}]+|[;“”„«»‹›「」『』《》〈〉()（）\[\]【】{{}}\"＂‘’\n]|(?<=[฀-๿])[ \t  ​]+(?=\S)|[\U00010A00-\U0001FFFF]")
_SPACE = re.compile(r"[\s​⁠﻿­]*")
_FIRST_WORD = re.compile(r"\S+")
_PARTICLE = re.compile(r"[とってはがのをにも라이고하며면는]|という")


def _kind(c: str) -> str:
    """U upper case, l lower case, d digit, c letter of a script without case, o opener, x other."""
    if c.isupper() or c.istitle():
        return "U"
    if c.islower():
        return "l"
    if c.isdecimal():
        return "d"
    if c.isalpha() or unicodedata.category(c)[0] in "LMN":
        return "c"
    if c in PAIRS or c in "¿¡":
        return "o"
    return "x"


def _matched(text: str, lo: int, hi: int) -> tuple[dict[int, int], dict[int, int]]:
    """Openers to closers and back within a span; what is never closed has no level of its own."""
    opens: dict[int, int] = {}
    closes: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        if c == "’" and (i + 1 < hi and text[i + 1].isalpha() or not any(o == "‘" for o, _ in stack)):
            continue  # an apostrophe
        for depth in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[depth][0]] and not (c == '"' and i + 1 < hi and stack[depth][0] == '"' and text[i - 1].isspace() and not text[i + 1].isspace() and depth < len(stack) - 1):
                opens[stack[depth][1]], closes[i] = i, stack[depth][1]
                del stack[depth:]
                break
        else:
            if c in PAIRS:
                stack.append((c, i))
    return opens, closes


_QUOTE = re.compile(r"[“”„«»‹›「」『』《》〈〉()（）\[\]【】{}\"＂‘’]")


def _word_before(text: str, lo: int, dot: int) -> tuple[int, str]:
    """The word that ends before ``dot``, with dots inside it ('p. ej' too), in lower case without invisible characters."""
    i = dot
    while i > lo and (text[i - 1].isalnum() or text[i - 1] in INVISIBLE or unicodedata.category(text[i - 1])[0] == "M" or text[i - 1] == "." and i - 2 >= lo and text[i - 2].isalpha()):
        i -= 1
    word = "".join(c for c in text[i:dot] if c not in INVISIBLE)
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
    return i, word


def _spaced_abbreviation(text: str, lo: int, start: int, word: str) -> str | None:
    """Abbreviations written with blanks between their parts: z. B., p. ej., т. д."""
    joined, i = word.lower(), start
    for _ in range(3):
        j = i
        while j > lo and text[j - 1].isspace():
            j -= 1
        if j == i or j <= lo or text[j - 1] != ".":
            return None
        i, part = _word_before(text, lo, j - 1)
        if not part or len(part) > 2:
            return None
        joined = f"{part.lower()}.{joined}"
        found = _lookup(joined)
        if found:
            return found
    return None


class _Span:
    """The automaton over one stretch of prose without empty lines."""

    def __init__(self, text: str, lo: int, hi: int, out: list[tuple[int, int]]):
        self.text, self.lo, self.hi, self.out = text, lo, hi, out
        self.start = lo
        self.width = 0

    def emit(self, end: int) -> None:
        a, b, text = self.start, end, self.text
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            self.out.append((a, b))
        self.start = end

    def first(self) -> int:
        i = self.start
        while i < self.hi and (self.text[i].isspace() or self.text[i] in INVISIBLE or self.text[i] in "*_"):
            i += 1
        return i

    def run(self) -> None:
        text, lo, hi = self.text, self.lo, self.hi
        opens, closes = _matched(text, lo, hi)
        depth, pos = 0, lo
        for m in _EVENT.finditer(text, lo, hi):
            i = m.start()
            if i < pos:
                continue
            c = text[i]
            if i in opens:
                if not depth and c in "(（" and self.aside(i, opens[i]):
                    self.emit(i)
                depth += 1
            elif i in closes:
                depth -= 1
            elif c == "\n":
                if not depth and self.hard_break(i):
                    self.emit(i)
            elif c in _ENDS or c == ";" and _GREEK.match(text[i - 1 : i]):
                end, opener = m.end(), -1
                while end < hi:
                    if end in closes:
                        opener, depth, end = closes[end], depth - 1, end + 1
                    elif text[end] in _ENDS or text[end] in CLOSING and end not in opens and text[end] not in '"“':
                        end += 1
                    elif text[end] in INVISIBLE and end + 1 < hi and (end + 1 in closes or text[end + 1] in _ENDS):
                        end += 1
                    elif text[end] in "   " and end + 1 in closes and text[end + 1] in "»›":
                        end += 1
                    elif text[end] == "*" and text[end : end + 2] == "**" and text.count("**", self.start, end) % 2:
                        end += 2
                    else:
                        break
                if not depth and self.ends(i, m.end(), end, opener, opens):
                    self.emit(end)
                pos = end
            elif not depth and c != ";" and c < "\U00010000" and c not in CLOSING and c not in PAIRS:  # a blank after Thai
                if self.thai_break(i, m.end()):
                    self.emit(i)
        self.emit(hi)

    def hard_break(self, i: int) -> bool:
        """Whether a line end without a final mark ends a sentence: the next word would have fitted on the line."""
        text, hi = self.text, self.hi
        begin = text.rfind("\n", self.lo, i) + 1 or self.lo
        line = text[begin:i].strip()
        m = _FIRST_WORD.search(text, i + 1, hi)
        if not line or not m or begin == -1:
            return False
        if "฀" <= line[-1] <= "๿":
            return True
        kind = _kind(text[m.start()])
        if line[-1] in ",;:-–—&/(«„“¿¡，、；：" or kind in "lx":
            return False
        if not self.width:
            self.width = max(len(x.strip()) for x in text[self.lo : hi].split("\n"))
        if len(line) < WRAPPED_CHARS or "\t" in text[self.lo : hi] or kind != "U":
            return False
        return len(line) + 1 + len(m.group()) <= WRAPPED_SHARE * self.width and self.width <= WRAPPED_WIDTH and "-\n" not in text[self.lo : hi]

    def aside(self, i: int, close: int) -> bool:
        """Whether a bracket is a sentence of its own, so that what stands before it ends even without a mark."""
        text = self.text
        if close - i < ASIDE_CHARS or text[close - 1] not in ".!?" or not text[i + 1].isupper() or not text[i - 1 : i].isspace():
            return False
        k = _SPACE.match(text, close + 1, self.hi).end()
        if k < self.hi and _kind(text[k]) not in "Uoc" or text[close - 1] == "." and _lookup(_word_before(text, i, close - 1)[1].lower()):
            return False
        return text[self.start : i].strip() != ""

    def thai_break(self, i: int, after: int) -> bool:
        kind = _kind(self.text[after])
        thai = sum("฀" <= c <= "๿" for c in self.text[self.start : i])
        return thai >= 8 and kind in "Uco"

    def ends(self, i: int, marks_end: int, end: int, opener: int, opens: dict[int, int]) -> bool:
        text, lo, hi = self.text, self.lo, self.hi
        k = _SPACE.match(text, end, hi).end()
        while k < hi and text[k] in "*_":
            k += 1
        if k >= hi:
            return True
        nxt, blank, line_end = text[k], any(c.isspace() for c in text[end:k]), "\n" in text[end:k]
        kind = _kind(nxt)
        marks = text[i:end]
        if nxt in ",;:，、；：،؛)）]】»”」』%" and k not in opens:
            return False
        if nxt in "-–—" and not line_end:
            return False
        whole = opener >= 0 and opener <= self.first()  # the quotation or bracket stands alone
        if any(c in _WIDE for c in marks):
            if opener < 0 or blank:
                return True
            return whole and not _PARTICLE.match(text, k)
        if any(c in _STRONG for c in marks):
            if kind == "l":
                return bool(line_end and opener < 0 and nxt.isalpha() is False) or self.camel(k) or blank and opener < 0 and self.uncapitalised(i)
            if not blank and opener >= 0 and not whole:
                return kind == "U"
            return kind in "Ucdo" or kind == "x" and blank
        if "…" in marks or ".." in marks:
            return kind in "Uo" and blank or kind == "c" and blank
        # a single dot, perhaps with closers
        closed = end > marks_end
        if not blank:
            if kind == "U":
                w, word = _word_before(text, lo, i)
                nword = _FIRST_WORD.match(text, k).group()
                return closed or self.joined(word, nword) and not self.file_like(w, k)
            if kind == "c":
                return i > lo and _kind(text[i - 1]) == "c" and (opener < 0 or whole)
            if kind == "o":
                return nxt in "¿¡" or nxt in "\"“«„「" and k in opens and i > lo and text[i - 1].isalpha()
            return False
        if not closed:
            w, word = _word_before(text, lo, i)
            if word:
                verdict = self.abbreviation(w, i, word, k, kind, opens)
                if verdict is not None:
                    return verdict
        if kind == "l":
            return self.camel(k) or not closed and self.uncapitalised(i)
        if kind == "x":
            return nxt in "$€£#+•@✓" or ord(nxt) > 0x2100
        return True

    def joined(self, word: str, after: str) -> bool:
        """Whether ``word``, a dot and ``after`` without a blank are two sentences and no name, number or abbreviation."""
        last = word.rpartition(".")[2]
        if len(after) < 2 or after[1] == "." and not (len(last) > 2 and last.islower()):
            return False
        if "." in word and word.islower() and len(word) < 5 and _lookup(word) != "trailing":
            return False
        if last.isupper() and len(last) > 2 and word == last and after[1].islower():
            return True  # a sentence in capitals
        return len(word) > 1 and (last[-1:].islower() or last[-1:].isdigit() or "." in word)

    def camel(self, k: int) -> bool:
        """Words such as pH begin a sentence in lower case."""
        return re.match(r"[a-z]{1,2}[A-Z]", self.text[k : k + 3]) is not None

    def uncapitalised(self, i: int) -> bool:
        """Whether the sentence so far is written without capitals, so that the next may begin without one."""
        a = self.first()
        return a < i and self.text[a].islower() and self.text[i - 1].isalpha() and not any(c.isupper() for c in self.text[a:i])

    def names_a_thing(self, w: int, k: int) -> bool:
        """Whether a lone capital ends its sentence: a word in lower case stands before it and one that opens sentences after it."""
        before = re.search(r"(\w+) $", self.text[max(self.lo, w - 30) : w])
        after = re.match(r"\w+", self.text[k : k + 12])
        return bool(before and before[1].islower() and after and after[0].lower() in OPENERS and self.text[k + after.end() : k + after.end() + 1] != ".")

    def file_like(self, w: int, k: int) -> bool:
        before = self.text[max(self.lo, w - 1) : w]
        return before in ("/", "\\", "@", "_")

    def abbreviation(self, w: int, i: int, word: str, k: int, kind: str, opens: dict[int, int]) -> bool | None:
        """False or True if the word before the dot decides, None if it doesn't."""
        text, lo, low = self.text, self.lo, word.lower()
        if word.isdecimal():
            if len(word) <= 2 and kind == "U":
                return False if re.match(r"\w+", text[k : k + 12])[0].lower() in MONTHS or _DOTTED_MONTH.match(text, k) else None
            return None
        if w > lo and text[w - 1] in "/_@":
            return None
        mark = _spaced_abbreviation(text, lo, w, word) or _lookup(low)
        if mark is None and "." in word and len(low.split(".")[0]) > 2:  # the end of a sentence without a blank, then an abbreviation
            cut = low.rfind(".") + 1
            w, word, low = w + len(word) - len(word[cut:]), word[cut:], low[cut:]
            mark = _lookup(low)
        if len(word) == 1 and mark != "trailing":
            after_number = re.search(r"\d[   ]?$", text[max(lo, w - 3) : w])
            if after_number and (word.islower() or kind != "U" or word in UNIT_SYMBOLS):
                return None
            if mark is None and word.islower() and kind == "U" and not re.search(r"\w\.\s*$", text[max(lo, w - 4) : w]) and text[k + 1 : k + 2] != ".":
                return None  # a word of one letter
            if mark is None and not (word.isupper() and kind in "Uo" or kind == "l" or word.isalpha() and kind in "dU"):
                return None
            return None if word.isupper() and kind == "U" and self.names_a_thing(w, k) else False
        if mark == "month":
            return False if kind == "d" and (word[0].isupper() or re.search(r"\d[.]?\s*$", text[max(lo, w - 4) : w])) else None
        if mark == "leading":
            return False
        if mark == "trailing":
            if kind == "U":
                nword = re.match(r"\w+", text[k : k + 12])
                follows = nword.group().lower() if nword else ""
                return not (low in COMPANY and follows in COMPANY)
            if kind == "o":
                if text[k] in "([（":
                    return k in opens and text[opens[k] - 1] in _ENDS
                return True
            return kind == "c" or kind == "l" and self.camel(k)
        if "." in word and len(low.replace(".", "")) <= 3 and all(len(p) == 1 for p in low.split(".")):
            return False if kind in "lxd" else None
        return None


def _units(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    """A block without empty lines: items, log and dump lines are units of their own, the rest is prose."""
    lines, p = [], lo
    while p < hi:
        e = text.find("\n", p, hi)
        e = hi if e < 0 else e
        lines.append((p, e))
        p = e + 1
    prose = -1
    # such lines are set off from prose, so a block holds either them or prose
    titles = all(_MARKER.match(text, a, b) or _LOG.match(text, a, b) or _DUMP.match(text, a, b) or _heading(text[a:b]) and not _closes_line(text, b) for a, b in lines if text[a:b].strip())
    previous, last_end = "start", lo

    def flush(end: int) -> None:
        nonlocal prose
        if prose >= 0:
            _Span(text, prose, end, out).run()
            prose = -1

    for n, (a, b) in enumerate(lines):
        if not text[a:b].strip():
            continue
        kind = "prose"
        if _LOG.match(text, a, b):
            kind = "log"
        elif _DUMP.match(text, a, b) and previous != "prose":
            kind = "dump"
        elif previous != "prose" and _MARKER.match(text, a, b):
            kind = "item"
        elif previous == "item" and text[a:b].lstrip()[:1].islower() and not _closes_line(text, last_end):
            kind = "more"
        elif titles or n + 1 < len(lines) and previous != "prose" and _heading(text[a:b]) and not _closes_line(text, b) and (_item_after_heading(text, *lines[n + 1]) or _LOG.match(text, *lines[n + 1])):
            kind = "heading"
        if kind == "prose":
            if prose < 0:
                prose = a
        elif kind == "more":
            s = out.pop()
            out.append((s[0], b - (len(text[a:b]) - len(text[a:b].rstrip()))))
            kind = "item"
        else:
            flush(a)
            line = _Span(text, a, b, out)
            line.emit(b)
        previous, last_end = kind, b
    flush(hi)


_INNER_END = re.compile(r"[^\d\W][.!?]\s|[。！？]|\d{3,}\.\s")


def _closes_line(text: str, end: int) -> bool:
    """Whether the line that ends at ``end`` ends with a final mark, perhaps closed by quotes."""
    i = end - 1
    while i >= 0 and (text[i].isspace() or text[i] in CLOSING or text[i] in INVISIBLE):
        if text[i] == "\n":
            return False
        i -= 1
    return i >= 0 and text[i] in _ENDS


def _item_after_heading(text: str, a: int, b: int) -> bool:
    """A wrapped line of prose may begin with a dash or number too, but then goes on in lower case."""
    m = _MARKER.match(text, a, b)
    return bool(m) and not text[m.end() - 1].islower()


def _heading(line: str) -> bool:
    """Short, without a final mark, and beginning like a title."""
    line = line.strip()
    return 0 < len(line) <= TITLE_CHARS and line[0] not in "\"“(" and (line[0].isupper() or line[0].isdigit()) and line[-1] not in ",;:-" and not _INNER_END.search(line)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets (start, end exclusive, in code points) of the sentences of ``text`` in order.

    Null, empty and blank texts have none. Empty lines always end a sentence.
    """
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    p = 0
    for m in _EMPTY.finditer(text):
        if m.start() > p:
            _units(text, p, m.start(), out)
        p = m.end()
    _units(text, p, len(text), out)
    return out


# ---------------------------------------------------------------- on DataFrames


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``key``, sentence_no, start_char, end_char (and with ``carry`` sentence) of every sentence of ``text``; no shuffle.

    Rows are independent: repeated rows give repeated sentences, null keys are kept, null, empty
    and blank texts give no rows, an empty table gives an empty result. Whole texts are read,
    whatever their length. Other columns are not carried.
    """
    field = documents.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                row, no, start, end, said = [], [], [], [], []
                for r, t in enumerate(batch.column(1).slice(lo, 512).to_pylist(), lo):
                    for n, (a, b) in enumerate(sentences(t)):
                        row.append(r)
                        no.append(n)
                        start.append(a)
                        end.append(b)
                        if carry:
                            said.append(t[a:b])
                columns = {"_key": keys.take(pa.array(row, pa.int64())), "sentence_no": pa.array(no, pa.int32()), "start_char": pa.array(start, pa.int32()), "end_char": pa.array(end, pa.int32())}
                if carry:
                    columns["sentence"] = pa.array(said, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"_key {field}, sentence_no int, start_char int, end_char int" + ", sentence string" * carry
    return documents.select(documents[key].alias("_key"), documents[text].alias("_text")).mapInArrow(cut, schema).withColumnRenamed("_key", key)
