"""What the sender of a mail newly wrote: history, signatures, device lines and notices marked line by line.

Messages of a thread come together; a thread too large for that is cut into blocks. For each message a generalised
suffix automaton over the words of the earlier messages of its thread is built; matches with it of many words are
inherited text, however the lines are wrapped, and mark history whether it has a mark or not. A match lies in one text,
so what a message inherits is the union of its matches with each block of its thread, and these are asked for wherever
message and block have a run of as many words in common. Marks and introductions that mail programs write are
read from the lines. What is left is stripped of recurring endings: sentences that recur beside notices all over the
corpus are learnt and belong to notices, lines that recur at the ends of mails of the thread are endings; signatures,
sign-offs and device lines have their forms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lettermill.llm.encoding import SUSPECT, _table, as_utf8, likely_codecs
from lettermill.session import forget, materialise

#: Turns of a block of a thread that does not come together.
WINDOW = 1024
#: Telling words of an inherited match that count as history where no mark says so.
INHERITED = 15

# Words of mail programs and of letters, by language where that matters.
QUOTE = re.compile(r"^\s{0,4}(?:[^\W\d_]{0,4}>|\|(?:[\s>|]|$))")
_VERBS = r"wrote|writes|said|says|schrieb|schreibt|geschrieben|a\s+écrit|écrit|a\s+ecrit|escribió|escribio|escreveu|pisze|napisał\(?a?\)?|написала?|пишет|ha\s+scritto|scrive|schreef|skrev|さんは書きました|書きました|のメッセージ"
_DATE = r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{1,2}\.?\s+\S{3,12}\.?\s+\d{4}|\S{3,12}\.?\s+\d{1,2},?\s+\d{4}|\d{4}年\s?\d{1,2}月\s?\d{1,2}日"
_MAIL = r"[\w.+'\-]+(?:@|\(at\)| at )[\w.\-]+\.\w+"
INTRO = re.compile(
    rf"^(?=.{{0,240}}$)(?:.*(?:{_VERBS})(?:\s+(?:am|on|le|el|em|dnia)?\s*(?:{_DATE}).{{0,40}})?\s*[:：]?|.*(?:schrieb|wrote|pisze|escreveu|escribió)\s+.{{0,120}}[:：]?|(?:quoting|citando|citation de|zitat von|zitiere)\s.*[:：]|.*(?:{_DATE}).*(?:{_MAIL}).*[:：]?)$",
    re.I,
)
_INTRO_SIGN = re.compile(rf"(?:{_VERBS})\s*[:：]?$|[:：]$|(?:{_MAIL})>?\s*[:：]?$", re.I)
_FROM = r"from|von|de|od|da|van|от|от кого|差出人|送信者|fra|från"
_OTHERS = r"sent|date|to|cc|subject|gesendet|datum|an|betreff|envoyé|envoye|date|à|a|objet|enviado|enviada em|fecha|para|asunto|assunto|data|wysłano|do|dw|temat|отправлено|дата|кому|копия|тема|送信日時|日時|宛先|件名|inviato|oggetto|verzonden|aan|onderwerp|reply-to"
FROM_LINE = re.compile(rf"^\s*\*?(?:{_FROM})\s*[:：]\*?\s*\S", re.I)
OTHER_LINE = re.compile(rf"^\s*\*?(?:{_OTHERS})\s*[:：]\*?", re.I)
SEPARATOR = re.compile(
    r"^\s*[-_=*]{2,}\s*(?:original message|forwarded (?:message|note|by.*)|message d.origine|message (?:transféré|original)|ursprüngliche nachricht|original-?nachricht|weitergeleitete nachricht|mensaje (?:original|reenviado)|mensagem (?:original|encaminhada)|(?:wiadomość oryginalna|oryginalna wiadomość|treść przekazanej wiadomości)|(?:исходное|пересылаемое|пересланное) сообщение|元のメッセージ|転送(?:された)?メッセージ|messaggio (?:originale|inoltrato)|oorspronkelijk bericht|doorgestuurd bericht)\s*[-_=*]{2,}\s*$",
    re.I,
)
FORWARDED = re.compile(r"^\s*(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado|início da mensagem (?:encaminhada|reenviada)|początek przekazywanej wiadomości|начало переадресованного сообщения)\s*[:：]\s*$", re.I)
ANY_TITLE = re.compile(r"^\s*[-_=*]{2,}\s*[^-_=*\n]{3,60}?\s*[-_=*]{2,}\s*$")
RULE = re.compile(r"^\s*(?:[_\-*=~#–—]\s?){5,}\s*$")
SIGNATURE_MARK = re.compile(r"^\s*(?:-- ?|--\s+|__|---|—|––|={2,}|~{2,}|[_*=~]{5,}|-{4,})\s*$")
DEVICE = re.compile(
    r"^\s*(?:sent (?:from|via) (?:my |a )?(?:[\w'’.-]+ ){0,4}[\w'’.-]+|get [\w'’.-]+ for [\w'’. -]+|gesendet (?:von meinem|mit|über) .{2,40}|von meinem .{2,30} gesendet|envoyé (?:de|depuis) (?:mon|ma) .{2,40}|enviado (?:desde|do|de) (?:mi|meu|minha|el) .{2,40}|wysłan[oey] z .{2,40}|отправлено (?:с|из) .{2,40}|inviato da(?:l mio)? .{2,40}|iphoneから送信|.{2,20}から送信|.*excuse (?:the |my )?(?:typos|brevity).{0,20})\s*[.!]?\s*$",
    re.I,
)
_DEVICE_NOT = re.compile(r"\b(?:the|this|that|our|their|your)\b|[,;:?]\s|\d{2,} ", re.I)
POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\.?\s*[:.\-–]?\s|ps\s?[:.]|з\.?ы\.?|追伸|nb[:.])", re.I)
_SIGN_OFFS = (
    "kind regards|best regards|warm regards|warmest regards|kindest regards|many thanks and best wishes|best wishes|many thanks|thanks and regards|thanks|thank you|thx|thanks again|thanks in advance|regards|best|all the best|cheers|br|rgds|kr|yours|yours sincerely|yours faithfully|yours truly|sincerely|sincerely yours|respectfully|cordially|take care|with best regards|with kind regards|love|xoxo|ciao|"
    "mit freundlichen grüßen|mit freundlichen grüssen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|herzliche grüße|schöne grüße|grüße|gruß|mfg|lg|vg|hochachtungsvoll|danke und gruß|vielen dank|"
    "cordialement|bien cordialement|très cordialement|bien à vous|bien à toi|à bientôt|amicalement|salutations|sincères salutations|meilleures salutations|respectueusement|bonne journée|bonne soirée|merci d.avance|merci|"
    "un saludo|saludos|saludos cordiales|un cordial saludo|cordiales saludos|atentamente|un abrazo|gracias|muchas gracias|muy atentamente|"
    "atenciosamente|cumprimentos|com os melhores cumprimentos|melhores cumprimentos|um abraço|abraços|abraço|obrigado|obrigada|cordialmente|att|"
    "z poważaniem|pozdrawiam|serdecznie pozdrawiam|pozdrowienia|z wyrazami szacunku|łączę pozdrowienia|dziękuję|dzięki|"
    "с уважением|всего доброго|с наилучшими пожеланиями|всего хорошего|с приветом|спасибо|до свидания|"
    "よろしくお願いします|よろしくお願いいたします|宜しくお願いします|宜しくお願い致します|敬具|以上|どうぞよろしくお願いします|"
    "cordiali saluti|distinti saluti|saluti|un saluto|met vriendelijke groet|groeten|groetjes|hälsningar|vänliga hälsningar|med vänlig hälsning|hilsen|med venlig hilsen|tervitades|parimat"
)
_NAME_WORD = r"(?:[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ�][\w’'.\-�]*|[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ]\.|van|von|de|da|del|der|di|la|le)"
_NAME = rf"{_NAME_WORD}(?:,?\s+{_NAME_WORD}){{0,3}}"
SIGN_OFF = re.compile(rf"^\s*(?i:{_SIGN_OFFS})\s*(?:[,!.;。、–-]*\s*|[,!.–-]\s*{_NAME}\s*[.!]?)$")
NAME_LINE = re.compile(rf"^\s*{_NAME}\s*$")
CONTACT_LINE = re.compile(
    r"^\s*(?:(?:t|tel|tél|telefon|teléfono|telefone|phone|mobile|mob|m|cell|fax|f|e|e-?mail|mail|w|web|тел|電話|☎|📞|✉|mailto|skype)\s*[.:]?\s?[:.]?\s*\S.*|[☎📞✉].*|(?:https?://|www\.)\S+|\S+@\S+|mailto:\S+|[+(\d][\d\s().\-/+]{5,}(?:\s?(?:ext|x|durchwahl|poste)\.?\s?\d+)?|.*\|.*)\s*$",
    re.I,
)
_ADDRESS_LINE = re.compile(r"\d|p\.?\s?o\.?\s?box|postfach|straße|str\.|street|road|lane|avenue|way|close|rue|calle|rua|ul\.|flat|unit|suite", re.I)
_NOTICE = re.compile(
    r"confidential(?:ity)?\s+(?:note|notice)|(?:this|the)\s+(?:e-?mail|message|communication|transmission)(?:\s+(?:message|transmission|communication))?\s*(?:\(|,|and|or|is|are|may|contains?|including|with|together)(?:.{0,80}\b(?:confidential|privileged|intended|meant only))|content of this (?:e-?mail|message)|intended (?:solely|only|recipient)|(?:received|receive) (?:it|this\b.{0,30}) in error|delete (?:every|all|any) cop(?:y|ies)|(?:accept|accepts|no) (?:no )?liability|registered (?:office|number)\b|consider the environment before print|views? expressed (?:here|in this)|unauthori[sz]ed (?:use|disclosure|copying|review)|any files attached to it|virus(?:es)?\b.{0,40}(?:liab|check|scan|free)|company (?:no|number|registration)|"
    r"nachricht ist vertraulich|nur für den empfänger|irrtümlich erhalten|vertrauliche informationen|bitte prüfen sie.{0,30}ausdruck|"
    r"message est confidentiel|réservé à son destinataire|reçu par erreur|merci de le détruire|n.imprimez|"
    r"mensaje es confidencial|dirigido solo a su destinatario|recibido (?:este mensaje )?por error|"
    r"mensagem é confidencial|se não é o destinatário|recebeu .{0,20}por engano|"
    r"wiadomość (?:jest|ma charakter) poufn|wyłącznie dla adresata|otrzymał\w* .{0,30}(?:omyłk|przez pomyłkę)|treść tej wiadomości|"
    r"сообщение (?:является )?конфиденциальн|предназначено (?:только )?(?:для )?(?:адресат|получател)|получили .{0,30}по ошибке|содержит конфиденциальн|"
    r"機密|秘密情報|宛先以外|誤って受信|受信者(?:のみ|以外)|"
    r"messaggio è riservato|vertrouwelijk|geadresseerde",
    re.I | re.S,
)
_VERB_END = re.compile(rf"(?:{_VERBS})\s*[:：]?$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|(?<=。)")
_WORD = re.compile(r"[^\W_]+")


class SuffixAutomaton:
    """Generalised over several texts: every run of words of any of them is a path from the start."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: str, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def inherited(self, words: list[str], least: int, telling: list[bool] | None = None) -> list[bool]:
        """For each word whether it lies in a match in which at least `least` words are telling (all, if it is not said)."""
        out = [False] * len(words)
        before = [0, *accumulate(telling)] if telling else range(len(words) + 1)
        state, n, marked = 0, 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            if n >= least and before[i + 1] - before[i + 1 - n] >= least:
                for k in range(max(marked, i + 1 - n), i + 1):
                    out[k] = True
                marked = i + 1
        return out


def _readable(body: str) -> str:
    """The body with garbled UTF-8 read again, for looking at; it keeps its lines."""
    if SUSPECT.search(body):
        for codec in likely_codecs(body):
            fixed = as_utf8(body, codec)
            if fixed.count("\n") == body.count("\n"):
                body = fixed
        if SUSPECT.search(body):
            body = "\n".join(_reread(x) if len(x) <= 46 and not x.isascii() and not QUOTE.match(x) else x for x in body.split("\n"))
    return body


#: Readings of a line by single-byte tables, and letters that lost bytes may have been; tried for what the rules know.
_TABLES = [("cp1252", "koi8-r"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "iso8859-2"), ("cp1252", "cp1250"), ("cp437", "cp1252"), ("cp1251", "cp1250"), ("mac_roman", "cp1252"), ("cp437", "cp1250")]
_LETTERS = "éüößäáóñłężçãàèêíúśćń"


@lru_cache(maxsize=1 << 16)
def _reread(line: str) -> str:
    bare = line.rstrip("\r")
    readings = [bare.translate(_table(wrong, right)) for wrong, right in _TABLES]
    if "�" in bare:
        readings += [re.sub("�{1,3}", c, bare) for c in _LETTERS] + [re.sub("�{1,3}", lambda m: next(pair, "?"), bare) for pair in (iter("üß"), iter("üß" * 4))]
    for t in readings:
        if t != bare and (SIGN_OFF.match(t) or _VERB_END.search(t)):
            return t
    return line


#: One of these is in every notice that the pattern finds; they spare it most paragraphs.
_NOTICE_HINTS = (
    "confiden", "privileg", "intended", "meant only", "content of this", "in error", "delete", "liability", "registered", "environment before", "views", "view expressed", "unauthori", "attached to it", "virus", "company ",
    "vertraulich", "empfänger", "irrtümlich", "destinataire", "erreur", "détruire", "imprimez", "confidencial", "destinatari", "destinatári", "por error", "engano", "poufn", "adresat", "omyłk", "pomyłk", "treść tej", "конфиденц", "адресат", "получател", "ошибке", "機密", "秘密情報", "宛先以外", "誤って受信", "受信者", "riservato", "geadresseerde",
)


_ADDRESS_IN = re.compile(r"\S+@\S+|https?://\S+|www\.\S+")
_DIGITS = str.maketrans("123456789", "0" * 9)
#: Words of a sentence that may be learnt as part of a notice.
LEARNT_WORDS = 4


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def sentence_key(sentence: str) -> int:
    """A number for a sentence, without case, digits and addresses, as these differ from sender to sender."""
    flat = sentence.lower()
    if "@" in flat or "/" in flat or "www." in flat:
        flat = _ADDRESS_IN.sub("@", flat)
    flat = " ".join(flat.translate(_DIGITS).split())
    return int.from_bytes(hashlib.blake2b(flat.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _speaks_of_notice(sentence: str) -> bool:
    """Whether a sentence has the words by which notices are known."""
    low = sentence.lower()
    return any(h in low for h in _NOTICE_HINTS) and bool(_NOTICE.search(sentence))


def paragraphs_of(body: str) -> Iterator[list[tuple[int, bool]]]:
    """(key, whether it speaks of a notice) of the longer sentences of each paragraph that is not marked as quoted."""
    current: list[str] = []
    text = _readable(body)
    low = text.lower()
    hinted = any(h in low for h in _NOTICE_HINTS)
    for line in [*text.split("\n"), ""]:
        bare = line.strip()
        if bare and not QUOTE.match(line) and not RULE.match(bare):
            current.append(bare)
        elif current:
            found = [(sentence_key(s), hinted and _speaks_of_notice(s)) for s in _sentences(" ".join(current)) if len(s.split()) >= LEARNT_WORDS]
            current = []
            if found:
                yield found


def _is_notice(text: str, learnt: frozenset[int]) -> bool:
    """Whether at least half of the sentences speak of a notice or are known from notices."""
    sentences = _sentences(text)
    hits = sum(_speaks_of_notice(s) or (bool(learnt) and sentence_key(s) in learnt) for s in sentences)
    return hits > 0 and 2 * hits >= len(sentences)


def _signature_like(lines: list[str]) -> bool:
    """A name (or nothing) followed by lines of contact, role or address."""
    if not lines or len(lines) > 9 or any(len(x) > 70 for x in lines):
        return False
    first, rest = lines[0], lines[1:]
    if not NAME_LINE.match(first):
        return False
    return all(CONTACT_LINE.match(x) or (len(x.split()) <= 8 and not re.search(r"[.!?。]\s*$", x) and (not x.rstrip().endswith(",") or _ADDRESS_LINE.search(x))) for x in rest)


def _header_block(lines: list[str], i: int) -> bool:
    """Whether a header of a quoted mail begins at line i."""
    if not FROM_LINE.match(lines[i]):
        return False
    after = [x for x in lines[i + 1 : i + 7] if x.strip()][:5]
    return sum(bool(OTHER_LINE.match(x)) for x in after[:4]) >= 2


def _runs(blank: list[bool]) -> Iterator[list[int]]:
    """Line numbers between blank lines."""
    run: list[int] = []
    for i, gap in enumerate([*blank, True]):
        if not gap:
            run.append(i)
        elif run:
            yield run
            run = []


NONE: frozenset = frozenset()


def _outer_marks(body: str, endings: frozenset[str] = NONE, learnt: frozenset[int] = NONE) -> tuple[list[str], list[bool], list[bool]]:
    """Lines, which of them are blank, and which are not new by their marks, forms, notices and `endings`."""
    lines = [x.rstrip("\r") for x in _readable(body).split("\n")]
    n = len(lines)
    blank = [not x.strip() for x in lines]
    old = [bool(QUOTE.match(x)) for x in lines]
    quoted = list(old)

    # Bare history: a title or a header of a mail, and what follows it.
    start = n
    for i in range(n):
        if old[i] or blank[i]:
            continue
        nxt = next((k for k in range(i + 1, min(n, i + 5)) if not blank[k]), None)
        titled = SEPARATOR.match(lines[i]) or FORWARDED.match(lines[i]) or ((ANY_TITLE.match(lines[i]) or RULE.match(lines[i])) and nxt is not None and _header_block(lines, nxt))
        if titled or _header_block(lines, i):
            start = i
            break
    for i in range(start, n):
        old[i] = True

    # Introductions of marked quotes: the last one to four lines before them.
    i = 0
    while i < min(start, n):
        if quoted[i] and (i == 0 or not quoted[i - 1]):
            k = i - 1
            while k >= 0 and blank[k]:
                k -= 1
            low = k
            while low > 0 and k - low < 3 and not blank[low - 1] and not quoted[low - 1]:
                low -= 1
            if k >= 0 and not quoted[k] and _INTRO_SIGN.search(lines[k].strip()):
                while low < k and re.search(r"[.!?。,;]\s*$", lines[low]) and not re.search(rf"(?:{_DATE}).*,\s*$", lines[low]):
                    low += 1
                found = None
                for top in range(low, k + 1):
                    joined = " ".join(x.strip() for x in lines[top : k + 1])
                    if INTRO.match(joined) and (_complete(joined) or (top == low and len(joined) < 90)):
                        found = top
                        break
                for j in range(found, k + 1) if found is not None else ():
                    old[j] = True
        i += 1
    # What a wrapped introduction inside a quote leaves without its mark.
    for i in range(1, n):
        if not old[i] and not blank[i] and quoted[i - 1] and (re.match(rf"^\s*<?{_MAIL}>?.{{0,30}}$", lines[i], re.I) or (i + 1 < n and quoted[i + 1] and len(lines[i]) < 60 and _INTRO_SIGN.search(lines[i].strip()))):
            old[i] = True

    # Paragraphs of what is left.
    paragraphs, current = [], []
    for i in range(n + 1):
        if i == n or blank[i] or old[i]:
            if current:
                paragraphs.append(current)
            current = []
        else:
            current.append(i)
    tail_open = True
    for k in range(len(paragraphs) - 1, -1, -1):
        p = paragraphs[k]
        text = [lines[i] for i in p]
        if POSTSCRIPT.match(text[0]):
            continue
        for i in p:
            if DEVICE.match(lines[i]) and (lines[i].lstrip().startswith("--") or not _DEVICE_NOT.search(lines[i].strip()[4:])):
                old[i] = True
        inner = [i for i in p if not RULE.match(lines[i])]
        if inner and _is_notice(" ".join(lines[i].strip() for i in inner), learnt):
            for i in p:
                old[i] = True
            continue
        marked = _mark_signature(lines, p, old, last=tail_open and k > 0)
        if marked is None:
            tail_open = False
    # A sign-off that stands alone before a signature in the next paragraph.
    for k, p in enumerate(paragraphs[:-1]):
        q = paragraphs[k + 1]
        if old[p[-1]] and SIGN_OFF.match(lines[p[-1]]) and not old[q[0]] and _signature_like([lines[i] for i in q]):
            for i in q:
                old[i] = True
    # Lines that recur at the ends of mails of the thread, upwards from the end.
    own = [i for i in range(n) if not blank[i] and not old[i]]
    while own and lines[own[-1]].strip() in endings and len(own) > 1:
        old[own.pop()] = True
    return lines, blank, old


def _words_left(lines: list[str], blank: list[bool], old: list[bool]) -> tuple[list[list[int]], list[tuple[int, list[str]]]]:
    """Runs of the lines that are neither blank nor marked, and the words of each of these lines."""
    runs = list(_runs([gap or mark for gap, mark in zip(blank, old, strict=True)]))
    return runs, [(i, _WORD.findall(lines[i].lower())) for run in runs for i in run]


def _telling(lines: list[str], runs: list[list[int]], common: frozenset[int]) -> list[bool]:
    """For each word of the runs whether it tells anything: those of sentences that many threads have do not."""
    telling: list[bool] = []
    for run in runs:
        for sentence in _sentences(" ".join(lines[i].strip() for i in run)):
            telling += [sentence_key(sentence) not in common] * len(_WORD.findall(sentence.lower()))
    return telling


def line_marks(body: str, automaton: SuffixAutomaton | None = None, endings: frozenset[str] = NONE, learnt: frozenset[int] = NONE, common: frozenset[int] = NONE, far: Sequence[tuple[int, int]] = ()) -> list[int]:
    """Numbers of the non-blank lines that are not the sender's new text. `endings`: lines that recur at ends of mails of the
    thread; `learnt` and `common`: keys of sentences that belong to notices, and that many threads have; `far`: ranges of the
    words left that are inherited from mails that the automaton doesn't have."""
    lines, blank, old = _outer_marks(body, endings, learnt)
    n = len(lines)
    # History without marks: long matches with earlier mails of the thread, however they are wrapped. What words tell is looked
    # at only where there is a match at all.
    if automaton is not None or far:
        runs, found = _words_left(lines, blank, old)
        words = [w for _, ws in found for w in ws]
        hits = [False] * len(words)
        if automaton is not None and len(words) >= INHERITED and any(hits := automaton.inherited(words, INHERITED)) and common:
            hits = automaton.inherited(words, INHERITED, _telling(lines, runs, common))
        for start, end in far:
            hits[start:end] = [True] * (end - start)
        at = 0
        for i, ws in found:
            old[i] = 2 * sum(hits[at : at + len(ws)]) > len(ws)
            at += len(ws)
    # Rules that only fence what has been marked.
    for i in range(n):
        if not old[i] and RULE.match(lines[i]) and not blank[i]:
            near = [k for k in (next((k for k in range(i - 1, -1, -1) if not blank[k]), None), next((k for k in range(i + 1, n) if not blank[k]), None)) if k is not None]
            if any(old[k] for k in near):
                old[i] = True
    return [i for i in range(n) if old[i] and not blank[i]]


def _complete(joined: str) -> bool:
    """Whether an introduction has its beginning: a date, a preposition, a name or an address before the verb."""
    return bool(re.match(rf"^\s*(?i:on|am|le|el|em|il|op|at|w dniu|dnia|den|quoting|citando|zitat)\b|^\s*(?:{_DATE})|^\s*<?{_MAIL}>?.*[:：]$|^\s*{_NAME}\s*(?:<|(?i:{_VERBS})|\()|^\s*[\"“']?{_NAME}[\"”']?\s*<?{_MAIL}|^\s*(?:(?i:mon|tue|wed|thu|fri|sat|sun)|\w{{2,3}}\.?),?\s+.*(?:{_DATE})", joined))


def _mark_signature(lines: list[str], p: list[int], old: list[bool], last: bool) -> bool | None:
    """Mark the signature that a paragraph ends with or is. None: the paragraph is (partly) new text."""
    text = [lines[i] for i in p]
    for k, i in enumerate(p):
        if SIGNATURE_MARK.match(lines[i]) and (k + 1 < len(p) or k > 0):
            rest = [x for x in text[k + 1 :] if not RULE.match(x)]
            if len(rest) <= 10 and all(len(x) <= 80 for x in rest) and (re.match(r"^\s*(?:--|__|---)\s*$", lines[i]) or _signature_like(rest) or not rest):
                low = k
                for j in range(k - 1, max(-1, k - 4), -1):
                    if SIGN_OFF.match(text[j]):
                        low = j
                for j in p[low:]:
                    old[j] = True
                return True if low == 0 else None
    for k, i in enumerate(p):
        if SIGN_OFF.match(lines[i]):
            rest = text[k + 1 :]
            if len(rest) <= 9 and all(len(x) <= 70 for x in rest) and (not rest or NAME_LINE.match(rest[0]) or _signature_like(rest)):
                for j in p[k:]:
                    old[j] = True
                return True if k == 0 else None
    if all(old[i] for i in p):
        return True
    if last and _signature_like(text) and (len(text) > 1 or (NAME_LINE.match(text[0]) and len(text[0].split()) >= 2)):
        for j in p:
            old[j] = True
        return True
    return None


def _ending_like(x: str) -> bool:
    return not (len(x) > 60 or re.search(r"[.!?。:,]$", x) or len(x.split()) > 7)


def _tail(body: str) -> list[str]:
    """Short lines at the end of what is not marked as quoted, that are no sentences."""
    own = [x.strip() for x in body.split("\n") if x.strip() and not QUOTE.match(x)]
    out = []
    for x in reversed(own[-12:]):
        if not _ending_like(x):
            break
        out.append(x)
    return out


def _source_words(body: str) -> list[str]:
    """The words that later mails may have inherited from this one."""
    return _WORD.findall(" ".join(x for x in body.lower().split("\n") if not QUOTE.match(x)))


def thread_lines(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """(msg_id, line) of lines that are not new, of a thread or one block of it: rows of turn, msg_id, body, the keys of its
    sentences that are learnt, and common; and of a block the lines that are endings in the thread, and the ranges of words
    that are inherited from other blocks."""
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
    seen: dict[str, set[int]] = {}
    for _, k, body, *_ in rows if len(rows) > 1 else ():
        for line in _tail(body):
            seen.setdefault(line, set()).add(k)
    together = frozenset(x for x, who in seen.items() if len(who) > 1)
    automaton: SuffixAutomaton | None = None
    for n, (_, k, body, learnt, common, endings, far) in enumerate(rows, 1):
        ranges = [(r["s"], r["e"]) for r in far or ()]
        for i in line_marks(body, automaton, together if endings is None else frozenset(endings), frozenset(learnt or ()), frozenset(common or ()), ranges):
            yield k, i
        if n < len(rows):
            automaton = automaton or SuffixAutomaton()
            automaton.add(_source_words(body))


#: Threads that must have a sentence before it may be learnt, or is common; the share of its paragraphs that speak of a notice
#: by another sentence; and how often what has been learnt is used to learn more.
LEARNT_THREADS, COMMON_THREADS, LEARNT_SHARE, LEARNT_ROUNDS = 5, 3, 0.8, 2
#: Messages, and characters of their bodies, that come together. Larger threads are cut into blocks of WINDOW turns; more of one
#: turn, or of broken turns, are parted by a hash.
MOST_TOGETHER, MOST_CHARACTERS = 2048, 1 << 20


def _thread() -> Column:
    """A message without a thread or a turn stands alone."""
    return F.coalesce(F.when(F.col("turn").isNotNull(), F.col("conv_id").cast("string")), F.concat(F.lit("m"), F.col("msg_id").cast("string")), F.lit("m"))


def sentence_marks(messages: DataFrame) -> DataFrame:
    """`msg_id`, `learnt`, `common`: keys of the sentences of each message that belong to notices, and that many threads have.

    Every unquoted paragraph of all messages counts. A sentence is learnt if it stands in LEARNT_THREADS threads and nearly
    always beside one that speaks of a notice or has been learnt before: endings of senders recur word for word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pars, keys, seeds = [], [], [], []
            for n, body in enumerate(batch.column(2).to_pylist()):
                for k, found in enumerate(paragraphs_of(body)):
                    for key, seed in found:
                        at.append(n)
                        pars.append(k)
                        keys.append(key)
                        seeds.append(seed)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pars, pa.int32()), pa.array(keys, pa.int64()), pa.array(seeds, pa.bool_())], names=["msg_id", "thread", "par", "key", "seed"])

    bodies = messages.where(F.col("body").isNotNull() & (F.trim("body") != "")).select("msg_id", F.xxhash64(_thread()).alias("thread"), "body")
    sentences = materialise(bodies.mapInArrow(run, "msg_id bigint, thread bigint, par int, key bigint, seed boolean"), "sentences")
    threads = sentences.select("key", "thread").distinct().groupBy("key").agg(F.count("*").alias("threads")).where(F.col("threads") >= COMMON_THREADS)
    counted = materialise(threads, "common")
    learnt = None
    paragraph = W.partitionBy("msg_id", "thread", "par")
    for _ in range(LEARNT_ROUNDS):
        speaking = sentences if learnt is None else sentences.join(learnt.withColumn("_l", F.lit(True)), "key", "left").withColumn("seed", F.col("seed") | F.coalesce("_l", F.lit(False)))
        others = F.sum(F.col("seed").cast("int")).over(paragraph) - F.col("seed").cast("int")
        beside = speaking.withColumn("_n", F.count("*").over(paragraph)).withColumn("_o", others).where(F.col("_n") > 1)
        often = beside.groupBy("key").agg(F.count("*").alias("all"), F.sum((F.col("_o") > 0).cast("int")).alias("beside")).where((F.col("all") >= LEARNT_THREADS) & (F.col("beside") >= LEARNT_SHARE * F.col("all")))
        learnt = materialise(often.join(counted.where(F.col("threads") >= LEARNT_THREADS), "key", "left_semi").select("key"), "learnt")
    flags = counted.select("key").join(learnt.withColumn("_l", F.lit(True)), "key", "left")
    return sentences.select("msg_id", "key").join(flags, "key").groupBy("msg_id").agg(F.collect_set(F.when(F.col("_l"), F.col("key"))).alias("learnt"), F.collect_set("key").alias("common"))


def old_lines(messages: DataFrame) -> DataFrame:
    """`msg_id`, `line_no` of each non-blank line of `body` that is not the sender's new text.

    Null and empty bodies give no row; a message that was taken in twice counts once (of different bodies under one
    id the first in order of thread, turn and body holds). A thread of any length, and a key that holds a third of all
    rows, is spread over tasks, as large threads are cut into blocks; messages without a thread or a turn stand alone.
    History without a mark is looked for in all earlier messages of the thread.
    """
    return _marked_lines(materialise(chosen_bodies(messages), "bodies"))


def chosen_bodies(messages: DataFrame) -> DataFrame:
    """`msg_id`, `conv_id`, `turn`, `body`: the one body of each message id that counts."""
    return (
        messages.where(F.col("body").isNotNull() & (F.trim("body") != ""))
        .groupBy("msg_id").agg(F.min(F.struct("conv_id", "turn", "body")).alias("m")).select("msg_id", "m.*")
    )


def _blocks(chosen: DataFrame) -> DataFrame | None:
    """`thread`, `w`, `parts` of the windows of threads that are too large to come together; none if there is no such thread."""
    size = F.count("*").alias("n"), F.sum(F.length("body")).alias("chars")
    large = chosen.groupBy(_thread().alias("thread")).agg(*size).where((F.col("n") > MOST_TOGETHER) | ((F.col("chars") > MOST_CHARACTERS) & (F.col("n") > 1)))
    large = materialise(large.select("thread"), "large")
    if large.isEmpty():
        return None
    parts = F.ceil(F.greatest(F.col("n") / MOST_TOGETHER, F.col("chars") / MOST_CHARACTERS, F.lit(1.0))).alias("parts")
    windows = chosen.select(_thread().alias("thread"), _window().alias("w"), "body").join(large, "thread", "left_semi")
    return materialise(windows.groupBy("thread", "w").agg(*size).select("thread", "w", parts), "blocks")


def _window() -> Column:
    return F.floor(F.coalesce("turn", F.lit(0)) / WINDOW).cast("bigint")


_BLOCK = ["thread", "w", "part"]


def _thread_endings(placed: DataFrame) -> DataFrame:
    """`msg_id`, `endings`: lines of each message that recur at the ends of mails of its thread, over all its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, tails = [], [], []
            for n, body in enumerate(batch.column(2).to_pylist()):
                tail = set(_tail(body))
                for x in tail | {y for x in _readable(body).split("\n") if (y := x.strip()) and _ending_like(y)}:
                    at.append(n)
                    lines.append(x)
                    tails.append(x in tail)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines, pa.string()), pa.array(tails, pa.bool_())], names=["msg_id", "thread", "line", "tail"])

    lines = materialise(placed.select("msg_id", "thread", "body").mapInArrow(run, "msg_id bigint, thread string, line string, tail boolean"), "ends")
    ends = lines.where("tail").groupBy("thread", "line").agg(F.count("*").alias("n")).where("n > 1").select("thread", "line")
    return lines.join(ends, ["thread", "line"], "left_semi").groupBy("msg_id").agg(F.collect_set("line").alias("endings"))


def _shingles(words: str) -> Column:
    """Hashes of the runs of INHERITED words of a text, by their first word."""
    there = F.split(words, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(there) - (INHERITED - 1)), lambda i: F.xxhash64(F.slice(there, i, INHERITED)))
    return F.when(F.size(there) >= INHERITED, runs).otherwise(F.array().cast("array<bigint>"))


def _inherited_from_afar(placed: DataFrame) -> DataFrame:
    """`msg_id`, `far`: ranges of the words left of each message that earlier messages of its thread have, in other blocks at least.

    A match consists of runs of INHERITED words that both texts have. Where all words of them are telling, the runs that any
    earlier message has are all that is inherited. A match with a run of which some words tell nothing must have its telling
    ones elsewhere in the same text, so the message is compared with each block that has such a run in an earlier message.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, left, tell = [], [], []
            for body, endings, learnt, common in zip(*(batch.column(i).to_pylist() for i in range(5, 9)), strict=True):
                lines, blank, old = _outer_marks(body, frozenset(endings or ()), frozenset(learnt or ()))
                runs, found = _words_left(lines, blank, old)
                sources.append(" ".join(_source_words(body)))
                left.append(" ".join(w for _, ws in found for w in ws))
                tell.append("".join("01"[t] for t in _telling(lines, runs, frozenset(common or ()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sources, pa.string()), pa.array(left, pa.string()), pa.array(tell, pa.string())], names=[*_BLOCK, "turn", "msg_id", "source", "words", "telling"])

    texts = placed.select(*_BLOCK, "turn", "msg_id", "body", "endings", "learnt", "common").mapInArrow(words, "thread string, w bigint, part bigint, turn bigint, msg_id bigint, source string, words string, telling string")
    texts = materialise(texts, "words")
    at = F.struct("turn", "msg_id")
    first = texts.select(*_BLOCK, at.alias("at"), F.explode(F.array_distinct(_shingles("source"))).alias("h")).groupBy(*_BLOCK, "h").agg(F.min("at").alias("first"))
    asked = texts.where(F.length(F.replace("telling", F.lit("0"), F.lit(""))) >= INHERITED)
    asking = asked.select("thread", F.col("w").alias("own_w"), F.col("part").alias("own_part"), at.alias("at"), "telling", F.posexplode(_shingles("words")).alias("s", "h"))
    asking = asking.withColumn("all_tell", F.substring("telling", F.col("s") + 1, F.lit(INHERITED)) == "1" * INHERITED).drop("telling")
    firsts = first.groupBy("thread", "h").agg(F.min("first").alias("first"))
    telling = asking.where("all_tell").join(firsts, ["thread", "h"]).where(F.col("first") < F.col("at")).select(F.col("at.msg_id").alias("msg_id"), "s", (F.col("s") + INHERITED).alias("e"))
    mixed = asking.where(~F.col("all_tell")).drop("s", "all_tell").distinct()
    met = mixed.join(first, ["thread", "h"]).where(((F.col("w") != F.col("own_w")) | (F.col("part") != F.col("own_part"))) & (F.col("first") < F.col("at")))
    pairs = materialise(met.select(*_BLOCK, F.col("at.msg_id").alias("msg_id")).distinct(), "pairs")
    queries = _with(pairs, asked.select("msg_id", "turn", "words", "telling")).select(*_BLOCK, "turn", "msg_id", "words", "telling")
    sources = texts.join(pairs.select(*_BLOCK).distinct(), _BLOCK, "left_semi").select(*_BLOCK, "turn", "msg_id", F.col("source").alias("words"), F.lit(None).cast("string").alias("telling"))
    ordered = sources.unionByName(queries).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "turn", "msg_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for batch in batches:
            ids, starts, ends = [], [], []
            for thread, w, part, _, k, text, telling in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (thread, w, part) != now:
                    now, automaton = (thread, w, part), SuffixAutomaton()
                there = text.split()
                if telling is None:
                    automaton.add(there)
                    continue
                hits = automaton.inherited(there, INHERITED, [t == "1" for t in telling])
                for run in _runs([not hit for hit in hits]):
                    ids.append(k)
                    starts.append(run[0])
                    ends.append(run[-1] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["msg_id", "s", "e"])

    return ordered.mapInArrow(compare, "msg_id bigint, s int, e int").unionByName(telling).groupBy("msg_id").agg(F.collect_set(F.struct("s", "e")).alias("far"))


def _with(messages: DataFrame, more: DataFrame) -> DataFrame:
    """`messages` with the columns of `more`, by an id that may be null."""
    return messages.join(more.withColumnRenamed("msg_id", "_id"), F.col("msg_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def _marked_lines(chosen: DataFrame) -> DataFrame:
    source = _with(chosen, sentence_marks(chosen))
    source = source.select(_thread().alias("thread"), _window().alias("w"), F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"), "msg_id", "body", "learnt", "common")
    blocks = _blocks(chosen)
    alone = source if blocks is None else source.join(blocks.select("thread").distinct(), "thread", "left_anti")
    given = alone.select("thread", F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("part"), "turn", "msg_id", "body", "learnt", "common", F.lit(None).cast("array<string>").alias("endings"), F.lit(None).cast("array<struct<s: int, e: int>>").alias("far"))
    if blocks is not None:
        placed = materialise(source.join(blocks, ["thread", "w"]).withColumn("part", F.pmod(F.xxhash64("msg_id"), F.col("parts"))).drop("parts"), "placed")
        ended = _with(placed, _thread_endings(placed)).withColumn("endings", F.coalesce("endings", F.array().cast("array<string>")))
        ended = materialise(ended, "ended")
        forget(placed)
        given = given.unionByName(_with(ended, _inherited_from_afar(ended)).select(given.columns))
    sorted_ = given.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "turn", "msg_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        ids: list[int] = []
        lines: list[int] = []

        def finish() -> None:
            for k, i in thread_lines(rows):
                ids.append(k)
                lines.append(i)

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], names=["msg_id", "line_no"])
            ids.clear()
            lines.clear()
            return out

        for batch in batches:
            for thread_, w, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (thread_, w, part) != now:
                    finish()
                    now, rows = (thread_, w, part), []
                rows.append(row)
            yield taken()
        finish()
        yield taken()

    return sorted_.mapInArrow(run, "msg_id bigint, line_no int")


def new_text(messages: DataFrame) -> DataFrame:
    """`msg_id` and `new_text`: the body of each message without the lines that are not new.

    The body is the one that `old_lines` marks; messages with nothing but null and blank bodies have an empty text if
    one of these is not null, else no row.
    """
    chosen = materialise(chosen_bodies(messages), "bodies")
    marks = _marked_lines(chosen).groupBy("msg_id").agg(F.collect_set("line_no").alias("marks"))
    blank = messages.where(F.col("body").isNotNull()).select("msg_id").distinct()
    lines = F.split("body", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.coalesce("marks", F.array().cast("array<int>")), i), x)), lambda x: x.isNotNull())
    whole = blank.join(chosen.select("msg_id", "body"), "msg_id", "left").join(marks, "msg_id", "left")
    return whole.select("msg_id", F.regexp_replace(F.coalesce(F.array_join(kept, "\n"), F.lit("")), r"^\s+|\s+$", "").alias("new_text"))
