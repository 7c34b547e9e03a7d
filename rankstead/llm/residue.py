"""Template residue, filler, error pages and script notices.

Normalised lines are counted by host. A line that recurs in a host, or in the whole collection, is boilerplate: code that
many notes quote, a menu, a footer. It is subtracted, and a document is set apart if its residual text holds evidence.

Evidence is of two strengths. A line that by itself is unmistakable evidence (a server's error message, mock Latin, a
field that no language but a template's writes) is never subtracted, as such a document counts however often the message
recurs. Template syntax that program code writes as well, wordings that menus use too, and what only several lines
together show, count only if they are left by the subtraction.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankstead.operators.skew import cut_lineage, lookup_skew_safe

#: A line is boilerplate if it stands in this share of its host's (or all) documents, and in this many.
BOILERPLATE_SHARE, BOILERPLATE_DOCS = 0.003, 5

# Cyrillic and Greek letters that look like Latin ones, and what they look like.
LOOK_ALIKES = str.maketrans("аеорсхуіјѕԁһкмтвνοαρΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХУ", "aeopcxyijsdhkmtbvoapabezhikmnoptyxabekmhopctxy")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f]")

# Words of mock Latin.
MOCK_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum".split()
)
# Short words of it that are words of living languages too.
_COMMON_LATIN = frozenset("sit do ut et ad ex ea in eu qui id est non sed dolor anim esse".split())
_TELLING = sorted(w for w in MOCK_LATIN - _COMMON_LATIN if len(w) > 4)

_NAME = r"[a-z][a-z0-9]*(?:[._ -][a-z0-9]+){0,6}"
_FIELD_EDGE = r"(?<![\w\"'`/={(\\])"
_FIELD_END = r"(?![\w\"'`/=})\\])"
_PYTHON_NAMES = "name|init|main|file|all|version|dict|doc|call|str|repr|len|iter|next|enter|exit|new|del|class|module|slots|eq|hash|path|author|future|getitem|setitem|contains|init_subclass|post_init"
# Words that stand between underscores for emphasis rather than name a field.
_PLAIN_WORDS = "the|a|an|and|or|but|not|no|of|in|on|at|to|from|by|for|with|without|as|that|this|these|those|it|its|is|are|was|were|be|if|than|then|only|all|any|each|both|very|note"
_TAGS = "html|head|body|title|table|thead|tbody|tr|td|th|div|span|pre|code|small|strong|font|center|script|style|meta|link|form|input|button|label|select|option|img|ul|ol|li|br|hr|em|sub|sup|blockquote|figure|caption|section|article|header|footer|nav|main|iframe|noscript|template|details|summary|mark|cite|abbr|address|video|audio|canvas|svg"

#: (kind, strings one of which is in all that the pattern matches, pattern), on folded text (see :func:`fold`).
EVIDENCE: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    (kind, tuple(triggers), re.compile(pattern))
    for kind, triggers, pattern in [
        # Fields of template languages.
        ("field", ["{{"], r"\{\{[-~#/>&^]?\s*[^{}\n]{1,60}?\s*\}\}"),
        ("field", ["{%"], r"\{%-?\s*[^%\n]{1,60}?\s*-?%\}"),
        ("field", ["<%"], r"<%[=-]?\s*[^%\n]{1,60}?\s*%>"),
        ("field", ["${", "#{"], rf"{_FIELD_EDGE}[$#]\{{\s*{_NAME}\s*\}}{_FIELD_END}"),
        ("field", ["[["], rf"\[\[\s*{_NAME}\s*\]\]"),
        ("field", ["@@"], rf"@@\s*{_NAME}\s*@@"),
        ("field", ["«"], r"«\s*[a-z]+(?:[._][a-z0-9]+)*\s*»"),
        ("field", ["%("], rf"{_FIELD_EDGE}%\({_NAME}\)[sdf]\b"),
        ("field", ["%"], rf"{_FIELD_EDGE}%[a-z][a-z0-9]*(?:[._][a-z0-9]+)*%{_FIELD_END}"),
        ("field", ["$"], rf"{_FIELD_EDGE}\$[a-z]{{3,}}(?:[._][a-z]+)*\${_FIELD_END}"),
        ("field", ["__"], rf"(?<![\w}}\"'`.])__(?!(?:{_PYTHON_NAMES}|{_PLAIN_WORDS})__)[a-z]+(?:[._][a-z]+)*__(?![\w{{(\"'`.\[])"),
        # An author's prompt that was never replaced.
        ("prompt", ["here", "in this "], r"\b(?:text|title|list|name|goes|table|legend|label|run|author|summary|reference|caption|cut-off|content|description)\b[^.\n]{0,40}\bgoe?s? (?:here\b|in this (?:box|space|field))|\bgoes here\b"),
        ("prompt", ["your own"], r"\breplace (?:it|this|me)\b[^.\n]{0,30}\bwith your own\b"),
        ("prompt", ["todo", "tbd", "fixme"], r"\b(?:todo|fixme|tbd)\s*[:–-]\s*(?:fill|add|insert|write|enter|replace|put|\w[\w -]{0,40}goes)"),
        ("prompt", ["fill in"], r"(?:^|[:\n])\s*fill in (?:the |your )?[a-z]"),
        ("prompt", ["click ", "tap "], r"\b(?:click|tap) (?:here )?to (?:edit|add|enter|insert|replace)\b"),
        ("prompt", ["xxx"], r"\bx{3,} ?[a-z][\w -]{1,40}? ?x{3,}\b"),
        ("prompt", ["["], r"\[(?:insert|enter|add|your|name of|title of|date of|type|put|replace|choose|select|describe)\b[^\]\n]{1,60}\]"),
        ("prompt", ["name]"], r"\[(?:first|last|full|company|user|client|customer)[ _]?name\]"),
        ("prompt", ["to come]", "here]", "release]"], r"\[[^\]\[\n]{2,60}? (?:to come|(?:goes )?here|before release)\]"),
        ("prompt", ["<your ", "<enter ", "<insert ", "<add ", "<name of ", "<put ", "<type "], r"<(?:your|enter|insert|add|name of|put|type) [^<>\n]{1,60}>"),
        ("prompt", ["<your ", "[your ", "[insert "], r"<your [a-z][^<>\n]{1,40}|\[(?:insert|your) [a-z][^\]\n]{1,40}"),
        # Filler.
        ("filler", ["lorem ipsum"], r"\blorem ipsum\b"),
        ("filler", ["dummy"], r"\bdummy (?:paragraph|sentence|text|copy|content|heading)\b[^.\n]{0,40}"),
        ("filler", ["example "], r"\bexample (?:heading|subheading|body copy|paragraph text)\b"),
        ("filler", ["text text text"], r"\btext text text\b"),
        ("filler", ["blah"], r"\bblah,? blah\b"),
        ("filler", ["mustertext", "blindtext", "platzhaltertext", "fulltext hier"], r"\b(?:mustertext|blindtext|platzhaltertext)\b"),
        ("filler", ["texto de relleno", "texto de ejemplo"], r"\btexto de (?:relleno|ejemplo)\b"),
        ("filler", ["texte d'exemple", "texte d’exemple", "faux texte", "texte de remplissage"], r"\b(?:texte d['’]exemple|faux texte|texte de remplissage)\b"),
        ("filler", ["ここに", "ダミーテキスト", "サンプルテキスト"], r"ここに[^。\n]{0,12}(?:入力|記入|挿入)|ダミーテキスト|サンプルテキスト"),
        ("filler", ["sample text", "filler text", "placeholder text", "asdf", "foo bar baz"], r"\b(?:sample|filler|placeholder) text (?:goes|here|for|to be|\()|\basdf(?:asdf|ghjk| asdf)|\bfoo bar baz\b"),
        ("filler", ["text here", "content here", "title here", "description here", "caption here"], r"\b(?:your|insert|add|enter|type)(?: your)?(?: own)? (?:text|content|title|description|caption) here\b"),
        ("filler", ["this is "], r"\bthis is (?:just |only )?(?:placeholder|filler|sample|dummy) (?:text|content)\b"),
        ("filler", ["ihr text"], r"\bhier (?:könnte|steht)[^.\n]{0,12} ihr text\b|\bihr text (?:hier|stehen)\b"),
        # Error messages as a server or page shows them.
        ("error", ["page not found", "file not found", "404 not found"], r"\b(?:page|404|file) not found\b"),
        ("error", ["you asked for", "you requested", "you are looking for"], r"\byou (?:asked for|requested|are looking for) (?:does not exist|could not be found|was not found|cannot be found|is not available)"),
        ("error", ["withdrawn", "deleted", "renamed"], r"\bmay have (?:been )?(?:moved|removed)\b[^.\n]{0,20}\b(?:withdrawn|deleted|renamed)\b"),
        ("error", ["server error"], r"\binternal server error\b"),
        ("error", ["bad gateway", "gateway time"], r"\bbad gateway\b|\bgateway time-?out\b"),
        ("error", ["http"], r"\bhttp(?:/\d(?:\.\d)?)? (?:error )?[45]\d\d\b"),
        ("error", ["request timed out", "connection timed out", "operation timed out"], r"\b(?:request|connection|operation) timed out\b"),
        ("error", ["down for maintenance"], r"\bis (?:currently |temporarily )?down for maintenance\b"),
        ("error", ["unavailable", "not available"], r"\b(?:service|page|site|server)\b[^.\n]{0,20}\b(?:is )?(?:temporarily |currently )?unavailable\b"),
        ("error", ["no longer available"], r"\bthis [a-z -]{2,30} is no longer available\b"),
        ("error", ["access denied", "permission denied", "403 forbidden"], r"\b(?:access|permission) denied\b|\b403 forbidden\b"),
        ("error", ["your account may not", "your session ", "sign in again"], r"\byour account may not\b|\byour session (?:has )?(?:ended|expired|timed out)\b|\bsign in again to\b"),
        ("error", ["something broke", "something went wrong"], r"\bsomething (?:broke while|went wrong)\b"),
        ("error", ["unable to load", "failed to load"], r"\b(?:unable|failed) to load [a-z -]{2,30}:"),
        ("error", ["could not connect"], r"\bcould not connect to [a-z -]{2,40}database\b|\bfatal: could not connect\b"),
        ("error", ["undefined index", "undefined variable", "undefined property", "undefined offset"], r"\bundefined (?:index|variable|property|offset)\b[^\n]{0,60}\b(?:on line|in )"),
        ("error", ["traceback (most", "exception in thread", "nullpointerexception", "segmentation fault", "stack trace:"], r"\btraceback \(most recent call last\)|\bexception in thread\b|\bnullpointerexception\b|\bsegmentation fault \(core|\bstack trace:"),
        ("error", ["too many requests"], r"\btoo many requests\b"),
        ("error", ["error ", "erreur ", "fehler ", "エラー"], r"\b(?:error|erreur|fehler) [45]\d\d\s*[:–-]|エラー ?[45]\d\d|[45]\d\d ?エラー"),
        ("error", ["your request"], r"\b(?:could not|cannot) (?:finish|complete|process) your request\b"),
        ("error", ["gefunden", "verweigert", "verfügbar", "erreichbar", "sitzung", "später"], r"\bseite (?:wurde )?nicht gefunden\b|\bzugriff verweigert\b|\bdienst ist[^.\n]{0,30}nicht (?:verfügbar|erreichbar)\b|\b(?:ihre )?sitzung ist abgelaufen\b|\bbitte versuchen sie es später\b"),
        ("error", ["erreichbar", "fehler beim laden", "interner serverfehler"], r"\b(?:dienst|seite|server) ist[^.\n]{0,40}nicht erreichbar\b|\bfehler beim laden der\b|\binterner serverfehler\b"),
        ("error", ["indisponible", "introuvable", "refusé", "expiré", "erreur interne", "réessayer"], r"\b(?:service|page|site) est [^.\n]{0,20}indisponible\b|\bpage (?:est )?introuvable\b|\bveuillez réessayer\b|\baccès refusé\b|\bsession a expiré\b|\berreur interne du serveur\b"),
        ("error", ["no está disponible", "no se encontró", "no encontrada", "denegado", "inicie", "error interno", "inténtelo"], r"\b(?:servicio|página|sitio) no está disponible\b|\bno se encontró la página\b|\bpágina no encontrada\b|\bacceso denegado\b|\binicie (?:la )?sesión de nuevo\b|\binténtelo de nuevo más tarde\b|\berror interno del servidor\b"),
        ("error", ["ページ", "アクセス", "サーバ", "セッション", "サービス", "しばらく"], r"サーバー?が(?:混み合って|混雑して|応答して?い?ません)|しばらくしてから(?:もう一度|再度)|ページ(?:が|は)(?:見つかりません|存在しません|表示できません)|アクセス(?:が拒否|できません|権限がありません)|サーバー?(?:エラーが|内部エラー|に接続できません)|内部サーバー?エラー|セッション(?:の有効期限|が切れ)|サービスは?[^。\n]{0,10}(?:利用できません|停止中|ご利用いただけません)"),
        ("error", ["requested", "you asked for", "looking for", "trying to "], r"\b(?:requested (?:url|page|file|resource|document)|you (?:requested|asked for)|you(?:'re| are| were) (?:looking for|trying to (?:reach|access|view|open)))\b[^.\n]{0,30}(?:\bnot\b|n['’]t\b|\bcannot\b|\bno longer\b)"),
        ("error", ["permission to", "not authori", "not allowed to"], r"\byou (?:don['’]t|do not) have permission to\b|\byou are not (?:authori[sz]ed|allowed) to (?:view|access|see|open)\b"),
        ("error", ["error establishing", "fatal error:", "server error in", "application error:", "parse error:", "uncaught "], r"\berror establishing an?\b|\b(?:fatal|parse|application) error:|\bserver error in ['\"/]|\buncaught \w*(?:error|exception)\b"),
        ("error", ["connection "], r"\bconnection (?:has timed out|was reset|was refused|refused)\b"),
        ("error", ["reached", "displayed", "be loaded"], r"\b(?:this|the) (?:site|page|server|website) (?:can['’]t|cannot|could not) be (?:reached|displayed|loaded)\b"),
        ("error", ["sorry for the inconvenience", "maintenance"], r"\bsorry for the inconvenience\b|\b(?:is|we are|we['’]re) (?:currently |temporarily )?(?:undergoing|performing)[^.\n]{0,20} maintenance\b"),
        ("error", ["encountered an"], r"\bserver (?:has )?encountered an\b[^.\n]{0,20}\berror\b"),
        # Notices that scripts are required.
        ("scripts", ["script"], r"\b(?:enable|turn on|activate|allow|switch on)\b[^.\n]{0,20}\b(?:javascript|scripts)\b"),
        ("scripts", ["javascript", "scripts"], r"\b(?:cannot|can't|can not|won't|will not|does not) (?:start|run|work|load|function)[^.\n]{0,20} without (?:javascript|scripts)\b"),
        ("scripts", ["script"], r"\bthis [a-z -]{2,30}(?:requires|needs) (?:javascript|scripts)\b|\b(?:javascript|scripts?) (?:is|are) (?:required|disabled|blocked|switched off|turned off)\b"),
        ("scripts", ["script"], r"\b(?:javascript|scripts|scripting) (?:must|has to|have to|needs to|need to) be (?:enabled|allowed|activated|turned on|switched on)\b"),
        ("scripts", ["browser"], r"\byour browser (?:allows scripting|has (?:them|scripts|javascript) (?:switched|turned) off|does not support (?:javascript|scripts))\b|\bcheck that your browser allows\b"),
        ("scripts", ["javascript"], r"\b(?:diese[rs]? [^.\n]{2,30} (?:benötigt|erfordert)|cette? [^.\n]{2,30} (?:nécessite|requiert)|est[ae] [^.\n]{2,30} (?:requiere|necesita)) javascript\b"),
        ("scripts", ["noscript"], r"\bnoscript:"),
        ("scripts", ["javascript", "skripte"], r"\b(?:aktivieren|schalten|erlauben) sie (?:bitte )?(?:javascript|skripte)\b|\b(?:javascript|skripte) (?:muss|müssen) aktiviert\b"),
        ("scripts", ["javascript", "スクリプト"], r"\b(?:veuillez |merci d['’])?activer (?:le )?javascript\b|\bactivez (?:le )?javascript\b|\bactive (?:el )?javascript\b|\b(?:habilite|debe activar|es necesario activar) (?:el )?javascript\b|(?:javascript|スクリプト) ?(?:を|が)(?:有効|必要|オン|無効|オフ)"),
    ]
]
# Template syntax that code writes too, and wordings of menus; they count on lines that aren't boilerplate.
_SNAKE = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"
WEAK: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    (kind, tuple(triggers), re.compile(pattern))
    for kind, triggers, pattern in [
        ("field", ["${"], r"\$\{\s*[a-z][\w. -]{1,60}\}"),
        ("field", ["{"], rf"(?<![\\$^_{{])\{{\s*{_SNAKE}\s*\}}(?!\}})"),
        ("field", ["%("], rf"%\({_SNAKE}\)[sdf]\b"),
        ("field", ["<"], rf"<{_SNAKE}>"),
        ("field", ["["], rf"(?<![\w\])])\[{_SNAKE}\](?![\[(])"),
        ("error", ["error"], r"\ban? (?:(?:unknown|unexpected|internal|fatal) )?error (?:has )?occurred\b|\boops\b[^.\n]{0,40}\berror\b"),
        ("error", ["try again"], r"\b(?:please )?try again (?:later|in a (?:few|moment))"),
    ]
]
# Fields whose names are in capitals, of four letters at least or of several words; looked for before the case is folded.
_CAPITALS = r"(?:[A-Z]{4,}[0-9]*|[A-Z][A-Z0-9]*(?=[._][A-Z]))(?:[._][A-Z0-9]+)*"
CAPITAL_FIELDS: list[tuple[str, re.Pattern]] = [
    ("{", re.compile(rf"(?<![\w\\^_$#{{\"'/]){{{_CAPITALS}}}(?![\w}}\"'/])")),
    ("<", re.compile(rf"<(?!/?(?:{_TAGS})>)(?=[A-Z])(?:{_CAPITALS}|[A-Z]{{4,}}(?: [A-Z]+)*)>", re.IGNORECASE)),
    ("[", re.compile(rf"(?<![\w\[])\[(?!INFO|WARN|DEBUG|ERROR|TRACE|FATAL|NOTE|SIC|TODO){_CAPITALS}\](?![\w(\]])")),
    ("$", re.compile(rf"(?<![\w\"'`/={{(\\])\${_CAPITALS}\$(?![\w\"'`/=}})\\])")),
]
_SENTENCE = re.compile(r"[^.\n!?]+")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alike letters unified, invisible characters and odd blanks dropped."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if INVISIBLE.search(text):
            text = INVISIBLE.sub("", text)
        if _OTHER_SCRIPT.search(text):
            text = text.translate(LOOK_ALIKES)
    return text.lower().replace("\t", " ")


@functools.cache
def _triggers() -> ahocorasick.Automaton:
    """All triggers in one automaton; each carries a mask of the patterns it stands for (EVIDENCE, mock Latin, WEAK)."""
    masks: dict[str, int] = {}
    for k, (_, words, _) in enumerate([*EVIDENCE, (None, _TELLING, None), *WEAK]):
        for w in words:
            masks[w] = masks.get(w, 0) | 1 << k
    out = ahocorasick.Automaton()
    for w, mask in masks.items():
        out.add_word(w, mask)
    out.make_automaton()
    return out


def _triggered(folded: str) -> int:
    mask = 0
    for _, m in _triggers().iter(folded):
        mask |= m
    return mask


def _mock_latin(folded: str) -> bool:
    """Whether some sentence of four or more words is mock Latin."""
    for sentence in _SENTENCE.findall(folded):
        words = _WORD.findall(sentence)
        if len(words) >= 4:
            telling = sum(w in MOCK_LATIN and w not in _COMMON_LATIN for w in words)
            if telling >= 3 and sum(w in MOCK_LATIN for w in words) >= 0.7 * len(words):
                return True
    return False


def _strong(text: str, folded: str, mask: int) -> str | None:
    for trigger, pattern in CAPITAL_FIELDS:
        if trigger in text:
            for m in pattern.finditer(text):
                if m.group(0).upper() == m.group(0):
                    return "field"
    own = mask & ((1 << len(EVIDENCE)) - 1)
    while own:
        k = (own & -own).bit_length() - 1
        own &= own - 1
        if EVIDENCE[k][2].search(folded):
            return EVIDENCE[k][0]
    return "filler" if mask >> len(EVIDENCE) & 1 and _mock_latin(folded) else None


def evidence(text: str | None) -> str | None:
    """The first kind of unmistakable evidence: ``field``, ``prompt``, ``filler``, ``error``, ``scripts``; null if none."""
    if not text:
        return None
    folded = fold(text)
    return _strong(text, folded, _triggered(folded))


def weak_lines(text: str, mask: int = -1) -> dict[str, str]:
    """Lines with weak evidence, normalised (:func:`_normal`), with its kind."""
    out = {}
    for line in text.split("\n"):
        folded = fold(line)
        for k, (kind, triggers, pattern) in enumerate(WEAK, len(EVIDENCE) + 1):
            if mask >> k & 1 and any(t in folded for t in triggers) and pattern.search(folded):
                out.setdefault(_normal(line), kind)
                break
    return out


def judge(text: str | None, boilerplate: set[int] = frozenset()) -> str | None:
    """The first kind of evidence in the residual text; ``boilerplate`` holds the numbers (from 0) of the lines to subtract.

    A line that is unmistakable evidence by itself is not subtracted, however often it recurs: decided on the line as it stands.
    """
    if not text:
        return None
    if boilerplate:
        text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in boilerplate or evidence(x))
    folded = fold(text)
    mask = _triggered(folded)
    strong = _strong(text, folded, mask)
    return strong or (min(weak_lines(text, mask).values(), default=None) if mask >> (len(EVIDENCE) + 1) else None)


def _plates(counts: DataFrame, sizes: DataFrame, share: float, least_docs: int) -> DataFrame:
    """The rows of ``counts`` (``n`` documents of ``host``) that are boilerplate, with ``n_docs``. ``sizes`` has a row per host."""
    return counts.filter(F.col("n") >= least_docs).join(sizes, "host").filter(F.col("n") >= F.lit(share) * F.col("n_docs"))


def _recurrent(lines: DataFrame, sizes: DataFrame, share: float, least_docs: int) -> DataFrame:
    """``host``, ``line``, ``n``, ``n_docs`` of the lines (``host``, ``line``: one row per document) that are boilerplate.

    Counting combines map-side, so a host with a third of the documents is no hot spot.
    """
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return _plates(counts, sizes, share, least_docs).select("host", "line", "n", "n_docs")


def _host(host: str):
    return F.coalesce(F.col(host), F.lit("")).alias("host")


def boilerplate_lines(df: DataFrame, text: str, host: str, share: float = BOILERPLATE_SHARE, least_docs: int = BOILERPLATE_DOCS) -> DataFrame:
    """``host``, ``line`` (normalised), ``n`` (documents of the host with it), ``n_docs`` of all boilerplate.

    A line counts once per document; blank lines don't count. Documents without a host form one of their own.
    """
    lines = df.select(_host(host), F.explode(F.array_distinct(_normal_lines(text))).alias("line")).filter("line <> ''")
    return _recurrent(lines, df.groupBy(_host(host)).agg(F.count(F.lit(1)).alias("n_docs")), share, least_docs)


def boilerplate(df: DataFrame, id_col: str, text: str, host: str, share: float = BOILERPLATE_SHARE, least_docs: int = BOILERPLATE_DOCS) -> DataFrame:
    """``host``, ``lines`` (array) and ``n_docs`` of every host that has boilerplate.

    A host has at most (lines per document) / ``share`` boilerplate lines, which bounds the array.
    """
    return boilerplate_lines(df, text, host, share, least_docs).groupBy("host", "n_docs").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def _normal_lines(text: str):
    """The lines of a text in lower case, digits as 0, blanks collapsed and cut off at both ends."""
    c = F.regexp_replace(F.translate(F.lower(F.col(text)), "123456789", "000000000"), r"[ \t\r\f\x0b]+", " ")
    return F.transform(F.split(c, "\n"), lambda x: F.trim(x))


def _digests(lines):
    """Digests of lines, two hashes each: what is counted and joined instead of the lines."""
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"))))


def find_residue(df: DataFrame, id_col: str, text: str, host: str, share: float = BOILERPLATE_SHARE, least_docs: int = BOILERPLATE_DOCS) -> DataFrame:
    """``id_col`` and ``kind`` of evidence (null: none) of every document, judged by its text without boilerplate.

    All lines are counted by host and over all. As subtraction only takes lines away, a document whose whole text holds no
    evidence has none left; all others are judged anew by their residual text. Null, empty and blank texts have no evidence.
    Only texts with evidence move, once, by row. A line of a hot host, or one that a third of the documents share, is told
    apart and broadcast (:func:`rankstead.operators.skew.lookup_skew_safe`). Repeated ids are judged row by row.
    """
    slim = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), _host(host))
    id_kind = slim.schema["_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([t if judge(t) else None for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts, b.column(2)], names=["_id", "_text", "host"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [judge(t, set(n or ())) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], names=["_id", "kind"])

    seen = cut_lineage(slim.mapInArrow(first, f"_id {id_kind}, _text string, host string").withColumn("_row", F.monotonically_increasing_id()))
    each = slim.select("host", F.explode(F.array_distinct(_digests(_normal_lines("_text")))).alias("_h")).filter("_h IS NOT NULL")
    counts = cut_lineage(each.groupBy("host", "_h.h1", "_h.h2").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut_lineage(seen.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs")))
    own = _plates(counts, sizes, share, least_docs).select("host", "h1", "h2", "n", F.lit(True).alias("in_host"))
    everywhere = F.lit("*").alias("host")  # the whole collection as one host
    total = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).select(everywhere, "h1", "h2", "n")
    whole = _plates(total, sizes.groupBy(everywhere).agg(F.sum("n_docs").alias("n_docs")), share, least_docs).select("h1", "h2", "n", F.lit(True).alias("in_all"))
    open_rows = seen.filter("_text IS NOT NULL")
    lines = open_rows.select("_row", "host", F.posexplode(_digests(_normal_lines("_text"))).alias("_at", "_h")).select("_row", "host", "_at", "_h.h1", "_h.h2").filter("h1 IS NOT NULL")
    left = lookup_skew_safe(cut_lineage(lines), cut_lineage(own), ["host", "h1", "h2"], "n", "left")
    left = lookup_skew_safe(cut_lineage(left), cut_lineage(whole), ["h1", "h2"], "n", "left")
    plates = left.filter("in_host OR in_all").groupBy("_row").agg(F.collect_list("_at").alias("_plates"))
    judged = open_rows.join(plates, "_row", "left").select("_id", "_text", "_plates").mapInArrow(again, f"_id {id_kind}, kind string")
    return seen.filter("_text IS NULL").select(F.col("_id").alias(id_col), F.lit(None).cast("string").alias("kind")).unionByName(judged.select(F.col("_id").alias(id_col), "kind"))


def _normal(line: str) -> str:
    return re.sub(r"^ | $", "", re.sub(r"[ \t\r\f\x0b]+", " ", re.sub(r"[0-9]", "0", line.lower())))
