"""Personal information in free text, found by weak supervision and replaced by typed placeholders.

Regular expressions, gazetteers and context propose spans and vote on them; no vote is trusted as such. Expectation
maximisation over the patterns of votes of all texts estimates how reliable each labeler is for each type and gives
every pattern a probability. A logistic classifier of spans is then trained on these probabilities, with the votes
and the shape of the span and its neighbours as features, and decides.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.encoding import SUSPECT, _byte_of, _table, _utf8_pattern, likely_codecs
from lettermill.llm.new_text import DEVICE
from lettermill.llm.reading import ENGLISH, FOREIGN
from lettermill.session import materialise

TYPES = ("EMAIL", "ID", "PHONE", "STREET", "NAME")
#: Name words that go to every executor, the most frequent ones; the others come to the bodies by a join.
MOST_NAME_WORDS = 200_000
BUCKETS = 256
#: White space that may be a line end with the marks of a quote.
_W = r"(?:[ \t ]|\r?\n(?:[^\W\d_]{0,3}[>|][ \t]?)*)"
_HOST = r"[\w-]+(?:\.[\w-]+)+"
_GAP = re.compile(rf"[ \t\u00a0]{{1,2}}|[ \t]?\r?\n(?:[^\W\d_]{{0,3}}[>|][ \t]?)*[ \t]?")
_COMMA = re.compile(rf",(?:{_GAP.pattern})")
EMAIL = re.compile(
    rf"(?<![\w.+'@/-])(?:[\w][\w.+'-]*@{_HOST}|[\w][\w.+'-]*{_W}?[\[({{<]{_W}?(?:at|@|AT){_W}?[\])}}>]{_W}?[\w-]+(?:(?:{_W}?[\[({{<]{_W}?(?:dot|\.|DOT){_W}?[\])}}>]{_W}?|\.|{_W}dot{_W})[\w-]+)+|[\w][\w.+'-]*{_W}@{_W}{_HOST}|[\w][\w.+'-]*{_W}(?:at|AT){_W}[\w-]+(?:{_W}(?:dot|DOT){_W}[\w-]+)+)"
)
_EXT = rf"(?:,?{_W}*(?:ext|extension|x|durchwahl|dw|poste|anexo|ramal|wew|доб)\.?{_W}?\d{{1,5}}\b)?"
_SEP = rf"(?:{_W}|[.\-/]|{_W}?[‐-–]{_W}?)"
PHONE = re.compile(
    rf"(?<![\w/.,:@#-])(?:(?:\+|00)\d{{1,3}}(?:{_SEP}?\(\d{{1,5}}\)|{_SEP}?\d{{2,9}})(?:{_SEP}?\d{{2,7}}){{1,5}}|\(\d{{2,5}}\){_SEP}?\d{{3,4}}(?:{_SEP}\d{{2,4}}){{1,2}}|0\d{{2,5}}{_SEP}\d{{3,6}}(?:{_SEP}\d{{2,4}}){{0,2}}|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}|\d{{3}}-\d{{4}}|\d{{3,4}}{_SEP}\d{{2,4}}{_SEP}\d{{2,4}}){_EXT}(?![\w/-]|[.,]\d)",
    re.I,
)
_PHONE_STRICT = re.compile(rf"^(?:(?:\+|00)[1-9].*|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}|0\d{{2,4}}{_SEP}\d{{4}}{_SEP}\d{{4}}|0\d{{4}}{_SEP}\d{{6}}|\d{{3}}([.-])\d{{3}}\1\d{{4}}|[2-9]\d{{2}}-\d{{4}}){_EXT}$", re.I)
ID = re.compile(
    rf"(?<![\w/.,:@#+-])(?:[A-Z]{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?[A-D]|[A-Z]{{1,2}}\d{{6,8}}[A-Z]?|\d{{8}}[A-Z]|\d{{3}}(?:-|{_W})\d{{2}}(?:-|{_W})\d{{4}}|\d{{6}}-\d{{4,5}}|\d{{2,3}}/\d{{3}}/\d{{4,5}}|\d{{2,4}}-\d{{2,4}}-\d{{2,4}}|\d{{9,11}})(?![\w/-]|[.,]\d)"
)
_UP = "A-ZÀ-ÖØ-ÞĀ-ŽА-Я"
_CAP = rf"[{_UP}][\w'’-]*"
_KIND = r"Street|Road|Lane|Avenue|Way|Close|Drive|Court|Walk|Bend|Place|Square|Terrace|Boulevard|Crescent|Row|Grove|Gardens|Mews|Alley|Quay|Parade|Rise|Hill|Green|Circle|Trail|Parkway"
_KIND += "|" + _KIND.upper() + r"|St\.|Rd\.?|Ave\.?|Blvd\.?|Ln\."
_UNIT = rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|No\.|FLAT|UNIT|APT\.?|SUITE){_W}?\d+[A-Za-z]?"
STREET = re.compile(
    rf"(?<![\w/-])(?:(?:{_UNIT},?{_W})?(?:\d{{1,5}}[A-Za-z]?,?{_W}(?:{_CAP}{_W}){{1,3}}?(?:{_KIND})(?!\w)|\d{{1,5}}[A-Za-z]?(?:{_W}(?:bis|ter))?,?{_W}(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours){_W}(?:(?i:de{_W}la|de|du|des){_W}|(?i:d|l)['’])?{_CAP}(?:{_W}{_CAP})?"
    rf"|{_CAP}(?:[- ]?(?:Straße|Strasse|Str\.|STRASSE|STRAßE|Weg|Platz|Gasse|Allee)|(?:straße|strasse|str\.|weg|platz|gasse|allee)){_W}\d{{1,5}}[a-zA-Z]?|(?:Calle|Avenida|Plaza|Rua|Travessa|Via|Viale|ul\.|al\.|ulica|ул\.){_W}(?:(?:de|da|do|la|del){_W})?{_CAP}(?:{_W}{_CAP})?,?{_W}(?:nº{_W}?)?\d{{1,5}}[a-zA-Z]?)(?:,{_W}{_UNIT})?"
    rf"|(?:P\.?{_W}?O\.?{_W}?Box|PO{_W}BOX|Postfach|Apartado|Caixa{_W}Postal|Skrytka{_W}pocztowa){_W}\d+(?:,{_W}{_UNIT})?)"
)
_TOWN = re.compile(rf",{_W}(?:(?P<pre>\d{{4,6}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_W}?\d[A-Z]{{2}}){_W})?(?P<a>{_CAP})(?P<more>{_W}(?P<b>{_CAP}))?")
_POST = re.compile(rf"{_W}\d{{4,6}}(?!\w)")
_PLAIN = "\\s\\x00-\\x26\\x28-\\x2c\\x2e-\\x40\\x5b-\\x60\\x7b-\\x7e\\u00a0“”„‘–—…«»\\u3000-\\u3002（），"
#: Words that may be a name: they begin with a capital or with what is not ASCII.
TOKEN = re.compile(f"[A-Z\\x80-\\u2018\\u201a-\\U0010ffff](?<![{_PLAIN}])[^{_PLAIN}]*")
_IN_WORD = re.compile(f"[^{_PLAIN}]")
# Words around spans, by which context votes.
_PHONE_YES = re.compile(r"(?:reach|call|ring|phone|tel|tél|telefon\w*|mobile|mob|cell|fax|text me on|text|numéro\b.*|nummer\b.*|numer\b.*|número\b.*|telefone\b.*|teléfono\b.*|номер\b.*|телефон\b.*|☎|📞|電話\S*|番号\S*|^t|^m|at|on|to|is|or|lautet|é|changé)\W*$", re.I)
_NUMBER_NO = re.compile(r"(?:ticket|batch|serial|part|invoice|reference|ref|series|measured|release|version|order|room|shelf|lane|port|model|article|item|lot|parcel|case|docket|account|counted|batch no|under number|bestellung|rechnung|commande|facture|pedido|factura|заказ|счет)\W{0,3}(?:no\.?|number|nr\.?|#)?\W*$", re.I)
_NUMBER_NO_AFTER = re.compile(r"^\W*(?:series|pulses|pieces|units|marks|days|tries|hours|metres|meters|kg|km|fits|is (?:ready|complete|late|overdue|missing|approved|unclear|damaged|too short|half done)|on the back|of the|entries|open)\b", re.I)
_ID_YES = re.compile(r"(?:passport|social security|\bssn|\bid\b|\bids\b|identity|national insurance|\bnino?\b|tax|steuer|personalausweis|reisepass|pesel|\bnip\b|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|insee|séc\w* sociale|passeport|pasaporte|passaporte|паспорт\w*|инн|снилс|my number|personal number|badge)[^\d\n]{0,24}$", re.I)
_ID_AFTER = re.compile(r"^\W*(?:belongs to|born in|gehört|appartient|pertenece|on the form|doesn.?t match)", re.I)
_STREET_YES = re.compile(r"(?:pick-?up point|moved to|send|to|at|address|tenant at|lives at|deliver|office|point|adresse|anschrift|dirección|endereço|adres|адрес|in|from)\W*$|(?:^|\n)[>|\s]*$", re.I)
_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|professor|sir|madam|herr|frau|monsieur|madame|m|mme|señor|señora|sr|sra|dom|pan|pani|г-н|г-жа|don|doña)\.?)[ \t ]*(?:\r?\n[>|\s]*)?$", re.I)
_GREET = re.compile(r"(?:\b(?:hi|hello|dear|hey|hallo|liebe[rs]?|guten (?:tag|morgen)|hola|buenos días|querid[oa]|bonjour|salut|chèr?e?|olá|oi|bom dia|car[oa]|cześć|dzień dobry|witaj|drogi|droga|szanown\w+|добрый день|здравствуйте|привет|уважаем\w+|good morning|thanks|morning)[, ]{1,2})$", re.I)
_NAME_YES = re.compile(r"(?:ask for|reach|for|with|and|from|by|to|is|add|belongs to|tell|copy|met|spoke with|falei com|rozmawia\w+ z|über|sobre|avec|para|de|von|an|от|с|cc|from:|to:|quoting|пользователь|hat|schrieb|a|sincerely,?|regards,?|best,?|cheers,?|thanks,?|br,?|on .{0,30}[\d:],?|am .{0,30}\d|\d{2}:\d{2},?|\d{4},?)[\s>|,:*]*$", re.I)
_SIGNED = re.compile(r"(?:^|\n)[>|\s]*[^\W\d_]+(?: [^\s,]+){0,3},[ \t]*$")
_NAME_AFTER = re.compile(r"^(?:[\s>|]*<[^<>\s]+@|[\s>|]*\([^()]*@|[\s>|]*(?:wrote|said|writes|schrieb|a\s+écrit|escribió|escreveu|pisze|написал|hat|übernimmt|s[’']occupe)\b|[ \t]*様|[ \t]*さん|,?\s*$|,?[ \t]*\r?\n|:\s*\r?\n|[ \t]*[-–!:,])", re.I)
_NAME_NO_AFTER = re.compile(r"^(?:-?\s?(?:Straße|Strasse|straße|strasse|Str\.)|\s+(?:Street|Road|Lane|Avenue|Way|Close|Works|Lab|Ltd|GmbH|Inc|Group|handset|phone|tablet|release)\b|@)", re.I)
_SAYS = re.compile(r"^\s+(?:[>|]\s*)*(?:said|says|asked|asks|thinks|told|wants|knows|meint|sagt|dit|dice|disse|mówi|сказал)\b", re.I)
_DEVICE_BEFORE = re.compile(r"(?:my|mon|ma|meinem|mi|meu|minha|mojego|моего|from)\s+$", re.I)
# The patterns above try a long list of words at every character. In ASCII text, words that stand at the end are looked up there, and the patterns
# decide only what is not such a word; other letters have more than one small letter, so there the patterns alone decide.
_MARKS = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_"))
_PHONE_YES_ENDS = ("reach", "call", "ring", "phone", "tel", "mobile", "mob", "cell", "fax", "text", "text me on", "at", "on", "to", "is", "or", "lautet")
_NUMBER_NO_ENDS = tuple("ticket batch serial part invoice reference ref series measured release version order room shelf lane port model article item lot parcel case docket account counted bestellung rechnung commande facture pedido factura".split())
_STREET_YES_ENDS = ("send", "to", "at", "address", "deliver", "office", "point", "adresse", "anschrift", "adres", "in", "from")
_NAME_YES_ENDS = tuple("reach for with and from by to is add tell copy met sobre avec para de von an cc quoting hat schrieb a sincerely regards best cheers thanks br".split()) + ("falei com",)
_DEVICE_ENDS = ("my", "mon", "ma", "meinem", "mi", "meu", "minha", "mojego", "from")
_GREET_ENDS = frozenset(", \n")
_ID_WORD = re.compile(r"passport|social security|ssn|id|national insurance|nin|tax|steuer|personalausweis|reisepass|pesel|nip|dni|nie|nif|cpf|insee|passeport|pasaporte|passaporte|my number|personal number|badge")
_NAME_YES_REST = re.compile(r"[\d:]|rozmawia")


def _phone_yes(before: str) -> bool:
    if before.isascii():
        low = before.rstrip(_MARKS).lower()
        if low.endswith(_PHONE_YES_ENDS):
            return True
        if not ("telefon" in low or "nummer" in low or "numer" in low or low in ("t", "m")):
            return False
    return bool(_PHONE_YES.search(before))


def _number_no(before: str) -> bool:
    tail = before.rstrip(_MARKS)[-10:]  # the longest word
    if tail.isascii():
        low = tail.lower()
        if low.endswith(_NUMBER_NO_ENDS):
            return True
        if not low.endswith(("no", "nr", "number")):
            return False
    return bool(_NUMBER_NO.search(before))


def _id_yes(before: str) -> bool:
    if before.isascii():
        first = _ID_WORD.search(before.lower())
        return first is not None and bool(_ID_YES.search(before, first.start()))
    return bool(_ID_YES.search(before))


def _street_yes(before: str) -> bool:
    if before.isascii() and "\n" not in before and (low := before.rstrip(_MARKS).lower()):
        return low.endswith(_STREET_YES_ENDS)
    return bool(_STREET_YES.search(before))


def _name_yes(before: str) -> bool:
    if before.isascii():
        low = before.lower()
        if low.rstrip(" \t\n\r\f\v\x1c\x1d\x1e\x1f>|,:*").endswith(_NAME_YES_ENDS):
            return True
        if not _NAME_YES_REST.search(low):
            return False
    return bool(_NAME_YES.search(before))


def _device_before(before: str) -> bool:
    if not before[-1:].isspace():
        return False
    return before.rstrip().lower().endswith(_DEVICE_ENDS) if before.isascii() else bool(_DEVICE_BEFORE.search(before))


#: Given names that are words as well.
_WORDS_TOO = frozenset("will hope mark grace june rose may april august art bill frank faith joy dawn amber ivy olive penny ray rob sue pat don drew chase chance violet lily daisy iris ruby pearl victor max rich jack".split())


#: Added to the role of a word that few name fields have, or that context alone takes for a name.
WEAK = 8
# Words in front of a name, and words there that are none.
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau monsieur madame m mme señor señora sr sra dom pan pani г-н г-жа don doña".split())
_GREETINGS = frozenset("hi hello dear hey hallo liebe lieber liebes hola querido querida bonjour salut cher chère olá oi caro cara cześć witaj drogi droga привет здравствуйте".split())
_NO_NAME = ENGLISH | FOREIGN | _TITLES | _GREETINGS | frozenset(
    "all team everyone everybody customer customers client colleague colleagues sirs friend friends folks both guys there members member partner user users subscriber support sales billing service services office info help desk admin news newsletter mailer daemon noreply please thanks regards best sincerely re fw fwd good morning monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "kunde kundin kunden kollegen damen herren alle zusammen freunde todos todas equipo equipe équipe tous toutes clients amigos amigas cliente clientes państwo wszyscy коллеги друзья все".split()
)
_FRONT = _TITLES | _GREETINGS
_FROM_LINE = re.compile(r"[>|\s*]*(?i:from|von|de|от|da|od)\s?:[\s*\"]*(?:[^\W\d_][\w'’-]*\.?,? ){0,3}$")
_NAME_OVER = re.compile(r"[ \t]*(?:[,!:]|\r?\n|$)")
_PERSON_AFTER = re.compile(r"[ \t]*(?:[,!:]|\r?\n|$|[\"\s>|*]*[<(\[][^<>()\s]+@|(?:wrote|said|writes|schrieb|a écrit|escribió|escreveu|pisze|написал)\b)")


class Names:
    """Words of personal names by role; `rare_given` and `rare_family` stand in few name fields."""

    def __init__(self, given: frozenset[str], family: frozenset[str], rare_given: frozenset[str] = frozenset(), rare_family: frozenset[str] = frozenset(), words_too: frozenset[str] = frozenset()):
        self.given, self.family = given, family
        self.words_too = words_too  # what a rare word with lost letters may be as well
        self.memo: dict[str, int] = {}
        self.seen: dict[str, tuple[str, int, int, bool] | None] = {}  # tokens as they stand: see token(); null for those that are no names whatever stands around them
        self.by_length: dict[int, list[str]] = {}
        for w in given | family:
            self.by_length.setdefault(len(w), []).append(w)
        self.extra: dict[str, int] = {}  # roles of words of the body at hand that are not among those that every executor has
        self.rare = Names(rare_given, rare_family, words_too=_NO_NAME | {"não"}) if rare_given or rare_family else None

    def role(self, token: str) -> int:
        """The role of a word by the gazetteer: by what every executor has of it, or by what came with the body."""
        known = self.memo.get(token)
        if known is None:
            known = self._role(token)
        return known or (self.extra.get(token.lower().replace("’", "'"), 0) if self.extra else 0)

    def _role(self, token: str) -> int:
        """1 given, 2 family, 3 either, 0 neither, and WEAK if only rare words say so; garbled letters are read in every way that tables allow."""
        low = token.lower().replace("’", "'")
        out = (low in self.given) + 2 * (low in self.family)
        if not out and low.endswith("'s"):
            out = 0
        if not out and not low.isascii():
            if "�" in low:
                shape = re.compile("".join("." if c == "�" else re.escape(c) for c in re.sub("�{2,4}", lambda m: "�" * (len(m.group()) // 2), low)))
                hits = [] if any(map(shape.fullmatch, self.words_too)) else [w for w in self.by_length.get(len(re.sub("�{2,4}", lambda m: "�" * (len(m.group()) // 2), low)), ()) if shape.fullmatch(w)]
                out = any(w in self.given for w in hits) + 2 * any(w in self.family for w in hits)
            else:
                for wrong, right in _TABLES:
                    t = token.translate(_table(wrong, right)).lower()
                    if t != low and (r := (t in self.given) + 2 * (t in self.family)):
                        out = r
                        break
        if not out and self.rare and (r := self.rare.role(token)):
            out = r + WEAK
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[token] = out
        return out

    def token(self, raw: str) -> tuple[str, int, int, bool]:
        """The word of a token (empty: none), how many characters it leaves off at the end, its role by what every executor has, and whether it is no name
        whatever stands around it, unless the body has it among its own."""
        word, left = raw, 0
        while word and word[-1] in "'’-":
            word, left = word[:-1], left + 1
        if word.endswith(("’s", "'s")):
            word, left = word[:-2], left + 2
        if not word or word[0].islower():
            out = "", 0, 0, True
        else:
            known = self.memo.get(word)
            role = self._role(word) if known is None else known
            out = word, left, role, not role and len(word) > 1 and (word.isupper() or word.lower() in _NO_NAME)
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[raw] = None if out[3] else out
        return out


_TABLES = [("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1251", "cp1250"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp437")]


def mapped(body: str) -> tuple[str, list[int] | None]:
    """The body with garbled UTF-8 read again, and where each of its characters begins in the body (null: unchanged)."""
    if body.isascii() or not SUSPECT.search(body):
        return body, None
    text, begin = body, None
    for codec in likely_codecs(body):
        byte_of, out, where, last = _byte_of(codec), [], [], 0
        for m in _utf8_pattern(codec).finditer(text):
            try:
                c = bytes(byte_of[x] for x in m.group()).decode()
            except UnicodeDecodeError:
                continue
            out.append(text[last : m.start()])
            where.extend(range(last, m.start()))
            out.append(c)
            where.append(m.start())
            last = m.end()
        if out:
            out.append(text[last:])
            where.extend(range(last, len(text)))
            begin = where if begin is None else [begin[i] for i in where]
            text = "".join(out)
    return text, (None if begin is None else [*begin, len(body)])


@lru_cache(maxsize=1 << 16)
def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


_SHAPES = {ord(c): "9" for c in "0123456789"} | {c: "a" for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))} | {c: "A" for c in (*range(65, 91), *range(0xC0, 0xDF))} | {9: " ", 10: " ", 13: " ", 0xA0: " "}


def _shape(span: str) -> str:
    """Kinds of the first characters."""
    return span[:16].translate(_SHAPES)


@lru_cache(maxsize=1 << 16)
def _shape_bucket(head: str) -> int:
    return _bucket(_shape(head))


def _word_before(text: str, start: int) -> str:
    before = text[max(0, start - 20) : start].rsplit(None, 1)
    return before[-1].lower() if before else ""


# Digits of a whole number with its country code.
_WHOLE = {"1": 11, "44": 12, "33": 11, "49": 12, "34": 11, "48": 11, "351": 12, "7": 11, "81": 12, "39": 12}


def _phone_end(text: str, start: int, end: int) -> int:
    """Where a number ends: before a line end if it is whole there and no extension follows."""
    cut = text.find("\n", start, end)
    while cut >= 0:
        head = text[start:cut].rstrip()
        rest = text[cut:end].lstrip("\r\n>| \t")
        digits = re.sub(r"\D", "", head.replace("(0)", ""))
        if re.match(r"(?:ext|extension|x|durchwahl|dw|poste|anexo|ramal|wew|доб)", rest, re.I):
            return end
        if head.startswith(("+", "00")):
            digits = digits[2:] if head.startswith("00") else digits
            whole = next((n for c, n in _WHOLE.items() if digits.startswith(c)), 11) <= len(digits)
        else:
            whole = bool(_PHONE_STRICT.match(head)) or bool(re.match(r"^\(\d{3}\)\s?\d{3}[\s-]\d{4}$", head))
        if whole:
            return start + len(head)
        cut = text.find("\n", cut + 1, end)
    return end


def _by_context(text: str, word: str, s: int, e: int, last: tuple[int, int, int] | None) -> int:
    """Role of a capitalised word that no name field has and that is no common word: after a title, as a greeting, in a From line, or as the rest of a
    name that ends there; 0 if nothing says that it is one. `last` is the name word before."""
    if len(word) < 2:
        return 0
    before = text[max(0, s - 20) : s].rstrip(" \t\r\n>|,").rsplit(None, 1)
    front = before[-1].lower().rstrip(".") if before else ""
    title = greeting = sender = False
    if front in _FRONT:
        title, greeting = front in _TITLES, front in _GREETINGS
    else:
        line = text.rfind("\n", 0, s) + 1
        sender = text.find(":", line, min(s, line + 24)) >= 0 and bool(_FROM_LINE.match(text[line:s]))
    after_name = last is not None and last[2] & 1 and text[last[1] : s] == " "
    if not (title or greeting or after_name or sender) or _NAME_NO_AFTER.match(text, e):
        return 0
    if title and _TITLE.search(text[max(0, s - 26) : s]):
        return WEAK + 2
    if greeting and _GREET.search(text[max(0, s - 26) : s]) and _NAME_OVER.match(text, e):
        return WEAK + 1
    if after_name and _PERSON_AFTER.match(text, e):
        return WEAK + 2
    if sender:
        if last is not None and last[0] >= line and last[1] < s and text[last[1] : s] == " ":
            return WEAK + 2 if _PERSON_AFTER.match(text, e) else 0
        n = TOKEN.match(text, e + 1) if text[e : e + 1] == " " else None
        return WEAK + 1 if n and n.group().lower() not in _NO_NAME and _PERSON_AFTER.match(text, n.end()) else 0
    return 0


def _names(text: str, names: Names) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of name words: (start, end, roles). `Family, Given` is one run; initials stand in the middle or in front."""
    tokens: list[tuple[int, int, int]] = []
    seen, extra = names.seen, names.extra
    for m in TOKEN.finditer(text):
        raw = m[0]
        known = seen.get(raw, ())
        if known is None and not extra:
            continue
        word, left, role, never = known or names.token(raw)
        if never and not (extra and word):
            continue
        s, e = m.span()
        if s and (c := text[s - 1]) != " " and c != "\n" and c not in "'’-" and _IN_WORD.match(c):
            continue  # within a word
        e -= left
        initial = len(word) == 1 and text[e : e + 1] == "." and word.isupper()
        if initial:
            role = 4
        elif not role:
            if extra:
                role = names.role(word)
            if not role:
                if never:
                    continue
                role = _by_context(text, word, s, e, tokens[-1] if tokens else None)
        if role:
            tokens.append((s, e + initial, role))
    gap, comma = _GAP, _COMMA
    i = 0
    while i < len(tokens):
        s, e, r = tokens[i]
        roles, j = [r], i
        turned = False
        while j + 1 < len(tokens):
            s2, e2, r2 = tokens[j + 1]
            c = text[e]
            if c not in " \t\u00a0\r\n,":
                break
            between = text[e:s2]
            if c != "," and len(roles) < 4 and (between == " " or gap.fullmatch(between)):
                if "\n" in between and (text.rfind("\n", 0, s) == -1 and s == 0 or re.fullmatch(r"[>|\s]*", text[text.rfind("\n", 0, s) + 1 : s])):
                    break  # a name that fills its line is not carried on
                has_family = any(x & 7 == 2 for x in roles) or (len(roles) > 1 and roles[-1] & 7 in (2, 3))
                if has_family and not (turned and r2 == 4):
                    break
                if turned and r2 & 7 == 2:
                    break
            elif comma.fullmatch(between) and len(roles) == 1 and r & 7 in (2, 3) and r2 & 7 in (1, 3) and not turned:
                turned = True
            else:
                break
            roles.append(r2)
            j += 1
            e = e2
        while roles and roles[-1] == 4 and not turned and len(roles) > 1:
            roles.pop()
            j -= 1
            e = tokens[j][1]
        if any(x != 4 for x in roles):
            yield s, e, roles
        i = j + 1


#: Type, start, end, votes, and the buckets of the shape and of the word before.
_SPACE, _DIGIT, _AT = re.compile(r"\s"), re.compile(r"\d"), re.compile(r"@|\bat\b", re.I)
_WRITTEN, _TLD = re.compile(r"[\[({<]|dot|\s@\s"), re.compile(r"\.[a-z]{2,}$|dot\W*[a-z]{2,}$", re.I)
_MARKED = r"(?:[^\W\d_]{0,3}[>|][ \t]?)*"
_WRAP = re.compile(rf"[ \t\u00a0\r\n](?:(?<=\n){_MARKED}|(?<=\r)\n{_MARKED}|(?<=[ \t\u00a0])){_W}*")  # one or more of _W
_TAIL_EXT = re.compile(_EXT + "$", re.I)
_DATED = re.compile(r"^(?:\d{4}-\d\d-\d\d|\d\d[./-]\d\d[./-]\d{2,4})$")
_OWN_LINE, _LINE_OVER = re.compile(r"(?:^|\n)[>|\s]*$"), re.compile(r"[ \t]*(?:\r?\n|$)")
_ID_STRICT = re.compile(r"^(?:[A-Z]{2}\d{7}|[A-Z]\d{7}[A-Z]|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}([- ])\d\d\1\d{4}|\d{6}-\d{4,5}|\d\d/\d{3}/\d{5}|\d{9})$")
_ISO_DAY = re.compile(r"^\d{4}-\d\d-\d\d$")
_RUE = re.compile(rf"(?i:rue|avenue|boulevard|place|chemin|allée|quai|route|cours){_W}.*?({_CAP})({_W}+)({_CAP})$")
_LINE_START = re.compile(r"(?:^|\n)[>|\s*]*$")
_DAY_BEFORE, _DAY_AFTER = re.compile(r"\d\.?\s*$"), re.compile(r"^\.?\s*\d")
_SENTENCE_START, _SMALL_NEXT = re.compile(r"(?:[.!?]\s+|^|\n[>|\s]*)$"), re.compile(r"^\s+[a-z]")
_RIGHT = re.compile(_HOST)
_SPELT = re.compile(rf"[\[({{<]{_W}?(?:at|@){_W}?[\])}}>]|\s@|@\s|\sat\s(?=\S+\sdot\s)", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses: plain ones from their `@`; the slower pattern looks only at what surrounds one that is spelt out or spaced."""
    done = 0
    if "(" in text or "[" in text or "{" in text or " @" in text or "@ " in text or "dot" in text or "DOT" in text or "<at" in text or "\n@" in text or "@\n" in text:
        for mark in _SPELT.finditer(text):
            low = max(done, mark.start() - 70)
            while 0 < low < mark.start() and not text[low - 1].isspace():
                low += 1
            for m in EMAIL.finditer(text, low):
                if m.start() > mark.end():
                    break
                if m.start() >= done and m.end() > mark.start():
                    yield from _plain_emails(text, done, m.start())
                    yield m.span()
                    done = m.end()
    yield from _plain_emails(text, done, len(text))


def _left(text: str, done: int, at: int) -> int:
    """Where the local part that ends at `at` begins, of any length; it begins with a letter or digit."""
    low = at
    while low > done and (text[low - 1].isalnum() or text[low - 1] in "_.+'-"):
        low -= 1
    while low < at and not (text[low].isalnum() or text[low] == "_"):
        low += 1
    return low


def _plain_emails(text: str, done: int, end: int) -> Iterator[tuple[int, int]]:
    at = text.find("@", done, end)
    while at >= 0:
        left = _left(text, done, at)
        right = _RIGHT.match(text, at + 1, end) if left < at else None
        if right and text[left - 1 : left] not in ("/", "@"):
            yield left, right.end()
            done = right.end()
        at = text.find("@", max(at + 1, done), end)


_HINTS = ("tra\u00dfe", "tr.", "ul.", "al.", "ulica", "ул.", "weg", "latz", "asse", "llee")
_HINT = re.compile("TRA|Box|BOX|Postfach|Apartado|Caixa|Skrytka|Calle|Avenida|Plaza|Rua|Travessa|Via|Weg")
_NUMBER = re.compile(r"\d\d*")
_FLAT = re.compile(rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|No\.|FLAT|UNIT|APT\.?|SUITE){_W}?\Z")
#: What may follow the number of a house, the last characters of _FLAT, and where STREET can begin.
_HOUSE, _UNIT_ENDS = re.compile(r"[A-Za-z]?[, \t\u00a0\r\n]"), "tem.TE \t\u00a0\n>|"
_STREET_START = re.compile(rf"[\d{_UP}uaу](?<![\w/-].)")


def _numbers(text: str) -> tuple[list[re.Match], list[re.Match], list[re.Match]]:
    """Matches of PHONE, ID and STREET, tried only where a number, or the letters before one, can begin them."""
    phones, ids, streets = [], [], []
    end_phone = end_id = end_street = 0
    whole = bool(_HINT.search(text)) or any(h in text for h in _HINTS)
    for m in _NUMBER.finditer(text):
        at = m.start()
        length = m.end() - at
        if at >= end_phone and (length > 2 or (at and text[at - 1] in "+(")):
            for low in (at - 1, at) if at and text[at - 1] in "+(" else (at,):
                if low > 1 and text[low - 1] == "+":  # +(1) ...
                    low -= 1
                if low >= end_phone and (p := PHONE.match(text, low)):
                    phones.append(p)
                    end_phone = p.end()
                    break
        if at >= end_id:
            low = at
            if at and (text[at - 1].isupper() or (length == 2 and text[at - 1].isspace())):
                low = at - 1
                while low and at - low < 8 and (text[low - 1].isupper() or text[low - 1] in " >|\n\r\t"):
                    low -= 1
            while low <= at:
                if low >= end_id and (low == at or text[low].isupper()) and (p := ID.match(text, low)):
                    ids.append(p)
                    end_id = p.end()
                    break
                low += 1
        if not whole and at >= end_street:
            p = None
            if at and text[at - 1] in _UNIT_ENDS and (f := _FLAT.search(text, max(end_street, at - 16), at)):
                p = STREET.match(text, f.start())
            if p is None and length < 6 and _HOUSE.match(text, m.end()):
                p = STREET.match(text, at)
            if p:
                streets.append(p)
                end_street = p.end()
    if whole:
        for m in _STREET_START.finditer(text):
            if m.start() >= end_street and (p := STREET.match(text, m.start())):
                streets.append(p)
                end_street = p.end()
    return phones, ids, streets


Span = tuple[str, int, int, tuple[int, ...], int, int]
#: A span with what it needs of the towns: names that must be among them, and names that must not, with the town it ends with.
Proposal = tuple[str, int, int, tuple[int, ...], int, int, tuple[str, ...], tuple[str, ...], str]


def candidates(body: str, names: Names, towns: frozenset[str]) -> list[Span]:
    """Spans proposed for a body: type, start, end, votes, shape, word before. Positions are those of the body as it stands."""
    return settle(proposals(body, names), towns)


def settle(proposed: list[Proposal], towns: frozenset[str]) -> list[Span]:
    """The spans, with the first reading of each street that the towns allow."""
    out: list[Span] = []
    street = -1
    for t, s, e, votes, shape, word, need, shun, _ in proposed:
        if t == "STREET":
            if s == street or not _ends_there(need, shun, towns):
                continue
            street = s
        out.append((t, s, e, votes, shape, word))
    return out


def _flat(text: str) -> str:
    """The text with line ends, marks of quotes and runs of blanks as one blank."""
    return _WRAP.sub(" ", text) if "\n" in text or "  " in text or "\t" in text or "\u00a0" in text else text


def _ends_there(need: tuple[str, ...], shun: tuple[str, ...], towns: frozenset[str]) -> bool:
    return all(x in towns for x in need) and not any(x in towns for x in shun)


def proposals(body: str, names: Names) -> list[Proposal]:
    """Spans proposed for a body. A street has one for each place where it may end, the one that needs most of the towns first."""
    text, begin = mapped(body)
    out: list[tuple] = []
    for s, e in _emails(text):
        span = text[s:e]
        plain = "@" in span and not _SPACE.search(span)
        host = span.rpartition("@")[2] if plain else _AT.split(span)[-1]
        out.append(("EMAIL", s, e, (1, 1 if plain or _WRITTEN.search(span) else 0, 1 if _TLD.search(host.strip()) else -1, 0)))
    if _DIGIT.search(text):
        phones, ids, streets = _numbers(text)
        for m in phones:
            s, e = m.span()
            if text.find("\n", s, e) >= 0:
                e = _phone_end(text, s, e)
            before, after, span = _flat(text[max(0, s - 44) : s]), _flat(text[e : e + 28]), _flat(text[s:e])
            digits = sum(map(str.isdecimal, _TAIL_EXT.sub("", span) if span.lower() != span.upper() else span))  # an extension has letters
            strict = bool(_PHONE_STRICT.match(span))
            dated = bool(_DATED.match(span))
            out.append(("PHONE", s, e, (1 if strict else -1, 1 if 7 <= digits <= 15 else -1, 1 if _phone_yes(before[-24:]) or _OWN_LINE.search(text[max(0, s - 12) : s]) and _LINE_OVER.match(text[e : e + 4]) else 0, -1 if dated or _number_no(before[-26:]) or _NUMBER_NO_AFTER.match(after) or _id_yes(before[-36:]) or _ID_AFTER.match(after) else 0)))
        for m in ids:
            s, e = m.span()
            before, after, span = _flat(text[max(0, s - 44) : s]), _flat(text[e : e + 28]), _flat(m.group())
            strict = bool(_ID_STRICT.match(span))
            out.append(("ID", s, e, (1 if strict else -1, 0, 1 if strict and (_id_yes(before[-36:]) or _ID_AFTER.match(after)) else 0, -1 if _number_no(before[-26:]) or _NUMBER_NO_AFTER.match(after) or _ISO_DAY.match(span) else 0)))
        for m in streets:
            s, whole = m.span()
            yes, no = 1 if _street_yes(_flat(text[max(0, s - 44) : s])) else 0, -1 if _number_no(text[text.rfind("\n", 0, s) + 1 : s]) else 0
            readings: list[tuple[int, tuple[str, ...], tuple[str, ...]]] = [(whole, (), ())]
            if pair := _RUE.search(m.group()):  # where no town has both words, the second begins the next sentence
                both = (f"{pair.group(1)} {pair.group(3)}".lower(),)
                readings = [(whole, both, ()), (s + pair.end(1), (), both)]
            for e, need, shun in readings:
                if t := _TOWN.match(text, e):
                    a, b, pre = t.group("a"), t.group("b"), t.group("pre")
                    ends = [(t.end(), f"{a} {b}".lower())] if b else []
                    for end, town in [*ends, (t.end("a"), a.lower())]:
                        if not pre and (p := _POST.match(text, end)):
                            end = p.end()
                        wanted = () if pre and town == a.lower() else (town,)
                        out.append(("STREET", s, end, (1, 1, yes, no), (*need, *wanted), shun, f"{a} {b or ''}".lower()))
                    if pre:
                        continue
                out.append(("STREET", s, e, (1, 0, yes, no), need, shun, ""))
    for s, e, roles in _names(text, names):
        near, after = text[max(0, s - 26) : s], text[e : e + 32]
        full = len(roles) > 1
        weak, given = True, False
        for x in roles:
            if x < WEAK and x != 4:
                weak = False
                given |= x != 2
        device = False
        if _device_before(near[-12:]):
            line = text[text.rfind("\n", 0, s) + 1 : (text.find("\n", e) + len(text) + 1) % (len(text) + 1)]
            device = bool(DEVICE.match(line.strip("> |\r")))
        too = not full and text[s:e].lower() in _WORDS_TOO
        yes = full and not weak  # of a whole name each word is the context of the other
        if not yes:
            yes = bool((near[-1:] in _GREET_ENDS and _GREET.search(near)) or _TITLE.search(near) or _SAYS.match(after) or (_LINE_OVER.match(after) and _SIGNED.search(text[max(0, s - 48) : s])))
            if not yes:
                line_start = bool(_LINE_START.search(near))
                yes = bool((not (too and line_start) and _name_yes(near)) or (line_start and _NAME_AFTER.search(after)))
        no = device or bool(_NAME_NO_AFTER.match(after)) or (not full and text[s - 1 : s] in ("@", "/", "."))
        if too and not no:
            dated = bool(_DAY_BEFORE.search(near) or _DAY_AFTER.match(after))
            no = dated or (bool(_SENTENCE_START.search(near)) and bool(_SMALL_NEXT.match(after)))
        out.append(("NAME", s, e, (1 if full else 0, 1 if given else -1 if weak and not yes else 0, 1 if yes else 0, -1 if no else 0)))
    placed = []
    for t, s, e, v, *more in out:
        need, shun, town = more or ((), (), "")
        where = (s, e) if begin is None else (begin[s], begin[e])
        placed.append((t, *where, v, _shape_bucket(text[s : min(e, s + 16)]), _bucket(_word_before(text, s)), need, shun, town))
    return placed


@lru_cache(maxsize=1 << 12)
def _pattern(t: str, votes: tuple[int, ...]) -> str:
    return t + ":" + "".join("-0+"[v + 1] for v in votes)


def em_probabilities(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability that spans with a pattern of votes are personal data: labelers are independent given the truth, their
    reliabilities and the share of true spans are estimated for each type. The first guess is that votes are mostly right."""
    out = {}
    for t in sorted({p.partition(":")[0] for p in counts}):
        rows = sorted((p, n) for p, n in counts.items() if p.startswith(t + ":"))
        votes = np.array([["-0+".index(c) for c in p.partition(":")[2]] for p, _ in rows])
        n = np.array([c for _, c in rows], float)
        score = (votes - 1).sum(axis=1) + np.where(votes[:, -1] == 0, -2, 0)
        q = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
        for _ in range(rounds):
            prior = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
            like = np.log([1 - prior, prior])[:, None] + np.zeros((2, len(rows)))
            for k in range(votes.shape[1]):
                for y, weight in ((0, n * (1 - q)), (1, n * q)):
                    freq = np.array([(weight * (votes[:, k] == v)).sum() for v in range(3)]) + np.array([(2.0, 1.0, 1.0), (1.0, 1.0, 2.0)][y])
                    like[y] += np.log(freq / freq.sum())[votes[:, k]]
            q = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
            # A vote against by context outweighs shape alone; this ties the classes to their meaning.
            q = np.where((votes[:, -1] == 0) & (votes[:, -2] < 2), np.minimum(q, 0.2), q)
        out |= {p: float(x) for (p, _), x in zip(rows, q, strict=True)}
    return out


_BASE = {t: k * (1 + 3 * 4 + 2 * BUCKETS) for k, t in enumerate(TYPES)}


def _features(t: str, votes: tuple[int, ...], shape: int, word: int) -> tuple[int, ...]:
    base = _BASE[t]
    a, b, c, d = votes
    return base, base + 2 + a, base + 5 + b, base + 8 + c, base + 11 + d, base + 13 + shape, base + 13 + BUCKETS + word


def train_classifier(rows: list[tuple[str, str, int, int, int]], probability: dict[str, float], rounds: int = 200) -> np.ndarray:
    """Weights of a logistic classifier, from distinct (type, pattern, shape, word) with their counts; the targets are the EM probabilities."""
    weights = np.zeros(len(TYPES) * (1 + 3 * 4 + 2 * BUCKETS))
    if not rows:
        return weights
    x = np.array([_features(t, tuple("-0+".index(c) - 1 for c in p.partition(":")[2]), s, w) for t, p, s, w, _ in rows])
    y = np.array([probability[p] for _, p, _, _, _ in rows])
    n = np.minimum(np.array([c for *_, c in rows], float), 1000.0)
    n /= n.mean()
    moment = np.zeros_like(weights)
    for _ in range(rounds):
        z = weights[x].sum(axis=1)
        error = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gradient = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), len(weights)) + 1e-5 * weights
        moment += gradient**2
        weights -= 0.5 * gradient / np.sqrt(moment + 1e-12)
    return weights


def choose(spans: list[Span], weights: list[float]) -> list[tuple[str, int, int]]:
    """The spans that the classifier accepts."""
    return pick([(t, s, e, sum(weights[i] for i in _features(t, votes, shape, word))) for t, s, e, votes, shape, word in spans])


def pick(scored: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of spans with their scores those above zero: whole addresses first where they overlap, then the more probable, then the longer."""
    order = sorted((t not in ("EMAIL", "STREET"), -z, s - e, t, s, e) for t, s, e, z in scored if z > 0)
    taken: list[tuple[int, int, str]] = []
    for *_, t, s, e in order:
        for a, b, _ in taken:
            if s < b and a < e:
                break
        else:
            taken.append((s, e, t))
    taken.sort()
    return [(t, s, e) for s, e, t in taken]


def name_words(accounts: DataFrame, addresses: DataFrame, least: int = 3, most: int = MOST_NAME_WORDS) -> tuple[Names, DataFrame | None]:
    """Gazetteer of name words from fields that hold names; those of fewer than `least` fields are rare. The `most` most
    frequent ones, and a table `w`, `r` (role) of the others, if there are any."""
    fields = accounts.select(F.col("owner_name").alias("n")).unionByName(addresses.select(F.col("display_name").alias("n"))).where(F.col("n").isNotNull())
    plain = fields.select(F.trim(F.regexp_replace("n", r"\s*(?:[|(–].*)?$", "")).alias("n"))
    turned = plain.select(F.when(F.col("n").contains(","), F.regexp_replace("n", r"^([^,]+),\s*(.+)$", "$2 $1")).otherwise(F.col("n")).alias("n"))
    parts = turned.where(F.col("n").rlike(r"^\p{L}[\p{L}'’\-]+(?: \p{L}\.)? \p{L}[\p{L}'’\-]+$")).select(F.lower(F.element_at(F.split("n", " "), 1)).alias("g"), F.lower(F.element_at(F.split("n", " "), -1)).alias("f"))
    words = parts.select(F.explode(F.array(F.struct(F.lit("g").alias("role"), F.col("g").alias("w")), F.struct(F.lit("f").alias("role"), F.col("f").alias("w")))).alias("x")).groupBy("x.role", "x.w").count()
    rows = words.orderBy(F.desc("count"), "w", "role").limit(most).collect()
    words_too = ENGLISH | FOREIGN | {"não", "responda", "responder", "noreply", "reply", "répondre", "antworten"}
    usual, rare = (
        [frozenset(r["w"] for r in rows if r["role"] == k and (r["count"] >= least) == many and (r["w"] not in words_too or r["w"] in _WORDS_TOO)) for k in "gf"] for many in (True, False)
    )
    names = Names(*usual, *rare)
    if len(rows) < most:
        return names, None
    n, w, role = rows[-1]["count"], rows[-1]["w"], rows[-1]["role"]
    later = (F.col("count") < n) | ((F.col("count") == n) & ((F.col("w") > w) | ((F.col("w") == w) & (F.col("role") > role))))
    left = words.where(later & (~F.col("w").isin(*words_too) | F.col("w").isin(*_WORDS_TOO))).withColumn("b", F.when(F.col("role") == "g", 1).otherwise(2))
    return names, left.groupBy("w").agg((F.sum("b") + F.when(F.max("count") < least, WEAK).otherwise(0)).cast("int").alias("r"))


def _with_names(bodies: DataFrame, more: DataFrame) -> DataFrame:
    """The bodies with `more`: the words of a table of names that they have, with their roles. Only distinct capitalised words are joined."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"([\p{Lu}\x{80}-\x{10FFFF}][\p{L}\p{M}'’\-]*)"), F.lit(1)), lambda x: F.replace(F.lower(x), F.lit("’"), F.lit("'"))))
    had = bodies.select("msg_id", F.explode(words).alias("w")).join(more, "w").groupBy("msg_id").agg(F.collect_set(F.struct("w", "r")).alias("more"))
    return bodies.join(had, "msg_id", "left")


def find_personal(messages: DataFrame, accounts: DataFrame, addresses: DataFrame, sample: int = 15_000) -> DataFrame:
    """`msg_id`, `pii_type`, `start_pos`, `end_pos` of every span of personal data in `body`, without overlaps.

    Null and empty bodies give no row; repeated messages count once. Every body is read once for its proposals, which are
    written to the shared folder. Patterns of votes and towns are counted over all of them, and the gazetteer counts all
    name fields; the classifier alone is fitted on about `sample` messages, chosen by a hash of their id,
    and decides for every message. The driver is given the vote patterns, the distinct features of the sample,
    MOST_NAME_WORDS names and the towns of at least three streets; other names are joined to the bodies that have them
    (and then found as they are written, not garbled). Different bodies under one id each give their spans.
    """
    names, more = name_words(accounts, addresses)
    bodies = messages.where(F.col("body").isNotNull() & (F.col("body") != "")).select("msg_id", "body")
    bodies = bodies.withColumn("more", F.lit(None).cast("array<struct<w:string,r:int>>")) if more is None else _with_names(bodies, more)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            offsets = [0]
            for k, body, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names.extra = {x["w"]: x["r"] for x in own} if own else {}
                found = proposals(body, names)
                street = -1
                for t, s, e, votes, shape, word, need, shun, town in found:
                    rows.append((t, s, e, _pattern(t, votes), shape, word, need, shun, town, t != "STREET" or s != street))
                    street = s if t == "STREET" else -1
                ids.append(k)
                offsets.append(len(rows))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_PROPOSED)
            spans = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _PROPOSED.values(), strict=True)], names=list(_PROPOSED))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["msg_id", "spans"])

    proposed = materialise(bodies.mapInArrow(propose, "msg_id bigint, spans array<struct<t:string,s:int,e:int,p:string,shape:int,word:int,need:array<string>,shun:array<string>,town:string,first:boolean>>"), "personal")
    # One count serves all: a street counts once, by its first reading; shapes and words before are those of the sample.
    share = max(1, proposed.count() // sample)
    once = proposed.select((F.pmod(F.xxhash64("msg_id"), F.lit(share)) == 0).alias("some"), F.explode("spans").alias("x")).where("x.first")
    sampled = lambda c: F.when(F.col("some"), F.col(c))
    counts = materialise(once.groupBy("x.t", "x.p", "x.town", sampled("x.shape").alias("s"), sampled("x.word").alias("w")).agg(F.count("*").alias("n")), "counts")
    patterns = {r["p"]: r["n"] for r in counts.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    towns = _towns(counts.where(F.col("town") != "").groupBy("town").agg(F.sum("n").alias("n")))
    counted = counts.where(F.col("s").isNotNull()).groupBy("t", "p", "s", "w").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in counted.orderBy(F.desc("n"), "t", "p", "s", "w").toLocalIterator()]
    weights = train_classifier(rows, em_probabilities(patterns))

    # What a pattern of votes is worth to the classifier, and where the weights of its type begin.
    worth = {p: float(sum(weights[i] for i in _features(t, tuple("-0+".index(c) - 1 for c in v), 0, 0)[:5])) for p in patterns for t, _, v in [p.partition(":")]}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            flat = spans.flatten()
            t, s, e, p, shape, word, need, shun, _ = (flat.field(i) for i in range(9))
            kinds, votes = t.dictionary_encode(), p.dictionary_encode()
            kind, types = kinds.indices.to_numpy(), kinds.dictionary.to_pylist()
            base = np.array([_BASE[x] for x in types], np.int64)[kind] + 13
            z = np.array([worth[x] for x in votes.dictionary.to_pylist()], float)[votes.indices.to_numpy()] + weights[base + shape.to_numpy()] + weights[base + BUCKETS + word.to_numpy()]
            starts, ends = s.to_numpy(), e.to_numpy()
            of = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
            there = z > 0
            if "STREET" in types:
                places = np.flatnonzero(kind == types.index("STREET"))
                last = -1, -1
                for i, must, never in zip(places.tolist(), need.take(pa.array(places)).to_pylist(), shun.take(pa.array(places)).to_pylist(), strict=True):
                    if (of[i], starts[i]) == last or not _ends_there(must, never, towns):
                        there[i] = False
                    else:
                        last = of[i], starts[i]
            held = np.flatnonzero(there)
            held = held[np.lexsort((starts[held], of[held]))]
            # Where neighbours overlap, all spans of their body are weighed against each other.
            body = of[held]
            torn = np.isin(body, body[1:][(body[1:] == body[:-1]) & (starts[held][1:] < ends[held][:-1])])
            some: dict[int, list[tuple[str, int, int, float]]] = {}
            for i in held[torn].tolist():
                some.setdefault(int(of[i]), []).append((types[kind[i]], int(starts[i]), int(ends[i]), float(z[i])))
            chosen = [(k, *x) for k, there_of in some.items() for x in pick(there_of)]
            held = held[~torn]
            ids = batch.column(0).take(pa.array(np.concatenate([of[held], np.array([k for k, *_ in chosen], np.int64)])))
            found = pa.concat_arrays([t.take(pa.array(held)).cast(pa.string()), pa.array([x for _, x, _, _ in chosen], pa.string())])
            starts = np.concatenate([starts[held], np.array([x for _, _, x, _ in chosen], np.int32)])
            ends = np.concatenate([ends[held], np.array([x for *_, x in chosen], np.int32)])
            columns = [ids, found, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["msg_id", "pii_type", "start_pos", "end_pos"])

    return proposed.mapInArrow(decide, "msg_id bigint, pii_type string, start_pos int, end_pos int").dropDuplicates()


#: Columns of a written proposal; `first` is false for further readings of a street.
_PROPOSED = {"t": pa.string(), "s": pa.int32(), "e": pa.int32(), "p": pa.string(), "shape": pa.int32(), "word": pa.int32(), "need": pa.list_(pa.string()), "shun": pa.list_(pa.string()), "town": pa.string(), "first": pa.bool_()}


def _towns(pairs: DataFrame, least: int = 3) -> frozenset[str]:
    """Names of places after streets, from (town, n): of one word, or of two that stand together most of the time."""
    words = pairs.select(F.split(F.trim("town"), " ", 2).alias("w"), "n").select(F.col("w")[0].alias("a"), F.get("w", F.lit(1)).alias("b"), "n")
    first = words.groupBy("a").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    both = words.where(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    two = {(r["a"], r["b"]) for r in both.join(first, "a").where(2 * F.col("n") > F.col("all")).select("a", "b").collect()}
    begun = {a for a, _ in two}
    return frozenset({f"{a} {b}" for a, b in two} | {r["a"] for r in first.select("a").collect() if r["a"] not in begun})


def one_body(messages: DataFrame) -> DataFrame:
    """`msg_id`, `body`: one body for each message id, the least of those that are not null; messages without any have a null one."""
    return messages.groupBy("msg_id").agg(F.min("body").alias("body"))


def mask_personal(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """`msg_id` and `masked`: the body of each message with its spans replaced by `[TYPE]`, the rest unchanged.

    Of different bodies under one id the least counts (`one_body`); `spans` must be those of it, as `find_personal` gives
    for `one_body(messages)`. Messages whose body is null give no row.
    """
    found = spans.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("spans"))
    once = one_body(messages).where(F.col("body").isNotNull())
    none = F.array().cast("array<struct<start_pos:int,end_pos:int,pii_type:string>>")
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(
        F.concat(acc["pieces"], F.array(F.substr(F.col("body"), acc["at"] + 1, x["start_pos"] - acc["at"]), F.concat(F.lit("["), x["pii_type"], F.lit("]")))).alias("pieces"), x["end_pos"].alias("at")
    )
    whole = lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substr(F.col("body"), acc["at"] + 1, F.length("body")))
    return once.join(found, "msg_id", "left").select("msg_id", F.aggregate(F.coalesce("spans", none), start, step, whole).alias("masked"))
