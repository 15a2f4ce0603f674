"""Template residue, filler, error pages and script notices (problem 9).

Records are cut into sentences and lines. A message that holds none of the cue words below can't be told to be
residue by any rule here; it ends there (a search for all cue words at once finds that out). The others are reduced to
tokens with numbers masked, and a fixed-depth prefix tree over the whole collection mines their templates: its inner
levels are the number of tokens, the first tokens and the cue words in their order, so that messages of a group agree
in every word a verdict can rest on; within a leaf, token lists that are alike become one template, with a wildcard
wherever they differ. The distinct messages are counted first, so a notice that stands in a third of all documents is
one message; each leaf is mined as one stream.

Each template is classified once, on what its words say and on the evidence it carries over the collection: the number
of documents, the share of a document its messages make up, and the wildcards, which are the places a generator fills.
Clear wording is enough by itself; wording that ordinary text shares needs evidence. The verdicts go back to all
documents of the template.

Unresolved slots stand inside otherwise ordinary messages; they are looked for in the messages themselves, unless the
message talks about the notation or is code.
"""

from __future__ import annotations

import re
from http import HTTPStatus

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import cut

DEPTH = 2
SIMILAR = 0.6
MESSAGE_TOKENS = 60
RECURS = 3
SHARE = 0.5
SHORT = 14
WILD = "<*>"

_ENDS = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|[\r\n\u2028\u2029]+")
_TOKENS = re.compile(r"/[\w./-]{2,}|\d+|\w+|[^\w\s]")
_NUMBER = re.compile(r"\d+$")

# Wordings of error pages, script notices and filler that are clear by themselves, as patterns on lower-case templates.
ERRORS = r"""
^(http )?(error|erreur|fehler|ошибка|错误) (code )?(<num>|<\*>)\b
^(<num>|404|403|500|502|503|504) (forbidden|not found|bad gateway|service|internal|gateway|unauthorized|moved|unavailable|error|too many)
\b(fehler|error|erreur) <num> ?\) ?\.?$
^(http )?error <num>
\bthe requested url\b.*\b(was )?not found on this server
^(access denied|zugriff verweigert|accès refusé|acceso denegado|доступ запрещ)
\byou don ' t have permission to (view|access)
\bcould not connect to the (database|server)
^gateway timed? ?out
^the server is (busy|temporarily|unable|overloaded)
^(this|the) (page|site|server) (is|could not be|cannot be|can ' t be) (not|found|displayed|reached|unavailable|temporarily)
^too many requests
^retry after <num> seconds
^oops !
\bwe can ' t find the page\b
^traceback \( most recent call last
^(php )?(warning|fatal error|notice|parse error) : (undefined|uncaught|unexpected|call to|allowed|cannot|trying)
^your session (for .* )?has expired
^please log in again
^we ' ll be back soon
^down for maintenance
\b(page|seite|página|страница|页面) (not found|nicht gefunden|no encontrada|no existe|не найдена|introuvable|未找到)
^(seite|página|страница) (nicht|no|не)\b.*(gefunden|encontrada|existe|найдена)
\ble serveur a rencontré
\bpage /\S+ does not exist
\bla página no existe\b
(页面|网页)(不存在|未找到|无法)
^internal server error$
^something went wrong
"""
SCRIPTS = r"""
^(please )?(enable|activate|turn on|allow) (java ?script|scripts|cookies)
\b(java ?script|scripts) (is|are|must be|has to be|need to be) (disabled|required|enabled|turned off|switched off|blocked)
\bneed to (turn on|enable|allow) (java ?script|scripts)
\b(have|having) (scripts|java ?script) (switched|turned) on\b
\brequires? (java ?script|scripts|cookies)
\bactivez?r? (le )?(java ?script|les scripts)
\b(aktivieren|schalten) sie (bitte )?(java ?script|skripte)
\b(activa|active|habilita|habilite) (el )?(java ?script|los scripts)
\b(включите|требуется|разрешите) (java ?script|скрипты)
(启用|开启|打开|需要) ?(java ?script|脚本)
^checking your browser
\benable cookies to\b
\b(java ?script|scripts) (to|um|pour|para) (view|anzuzeigen|afficher|ver)
"""
FILLER = r"""
^lorem ipsum (dolor|sit|amet|sed|do|ut|et|elit|magna|labore|tempor|aliqua|consectetur|adipiscing|eiusmod|incididunt|lorem|ipsum|<\*>)\b
^todo : (describe|write|add|fill|insert|replace|complete)
^tbd( tbd)+
^(asdf|qwer|qwerty|asd)( (asdf|qwer|test|asd|qwerty))+
^caption text
^(button label|sample text|dummy text|placeholder text|body text)\b
^(your|the) (headline|title|text|caption|subtitle|heading) (goes )?here
^add a (short |brief )?(description|title|caption|text|bio) (of|for|about) (your|the|this)\b.*\b(in this box|here|below)
^(type|write|enter|put|insert) your (answer|text|name|message|comment|title) here
^replace this (paragraph|text|sentence|block|section|image) with
^this is (placeholder|dummy|sample|filler) (copy|text|content)
^(click|tap) (here )?to (edit|add) (text|title|this)
^x{12,}
"""

# Words of notices in several languages, by the part they play. A notice joins a thing with what is wrong or wanted.
PLACES = "page site website webpage url server resource document link file seite webseite página sitio servidor page serveur pagina sito sayfa sunucu страница сайт сервер 页面 网页 网站 服务器".split()
FAULTS = """not found|does not exist|doesn ' t exist|no longer exists|no longer available|not available|unavailable|could not be found|cannot be found|can ' t be found|could not be loaded|failed to load
has been removed|is gone|permanently removed|timed out|nicht gefunden|nicht verfügbar|existiert nicht|nicht erreichbar|introuvable|indisponible|n ' existe pas|n ' existe plus|no encontrada|no encontrado|no existe|no disponible|no se encuentra
non trovata|non trovato|non disponibile|non esiste|bulunamadı|mevcut değil|não encontrada|não existe|niet gevonden|не найдена|не найден|не существует|недоступна|недоступен|找不到|不存在|未找到|无法访问""".replace("\n", "|").split("|")
SCRIPT_WORDS = "javascript|java script|cookies|scripts|скрипты|脚本".split("|")
WANTED = """enable|enabled|turn on|turned off|switch on|switched off|activate|allow|required|requires|needs|disabled|blocked|on in your|aktivieren|aktiviert|einschalten|deaktiviert|benötigt|activer|activez|désactivé|requis|nécessaire|habilitar|habilite|activar|active
desactivado|necesario|attivare|attiva|abilitare|abilita|disattivato|richiesto|etkinleştirin|gerekli|devre dışı|включите|включить|отключен|требуется|разрешите|启用|开启|打开|需要|禁用""".replace("\n", "|").split("|")
BROWSER = "your browser|ihrem browser|ihr browser|votre navigateur|su navegador|tu navegador|tuo browser|tarayıcı|браузер|浏览器|view this|use this|this site|this page|this app|to continue|refresh|reload".split("|")
FILL = "insert enter add type write put place your".split()
FILLED = "headline title subtitle text heading caption description content paragraph name image logo date message copy tagline summary bio quote".split()
HERE = "here hier ici aquí qui buraya здесь 此处".split()
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
#: Words of somebody who tells something in own words; a template of weak wording with one of them is ordinary.
TOLD = re.compile(r"\b(i|i ' m|we|my|our|me|us|he|she|they|who|someone|somebody|everyone|said|told|ich|wir|mein|je|nous|mon|yo|nosotros|io|noi|ben|я|мы|我|我们|without|why|how|what|if|when|because|instead|would|used to)\b")
# Notations of slots.
SLOTS = r"""
\{\{\{?\s*[\w.@ -]{1,40}\s*\}?\}\}
\{%-?\s*[\w.@ -]{1,40}\s*-?%\}
(?<![\w$`/={:(\[])\{(?:[a-z]+(?:[_.][a-z]+)+|[A-Z]+(?:_[A-Z]+)*|[a-z]+[A-Z]\w*|name|user|email|date|city|company|product|title)\}(?![\w`}])
%%\s*[A-Z_]+\s*%%
(?<!\w)%\([a-z_]+\)s
<%=?\s*@?[\w.]+\s*%>
<<\s*[A-Za-z_]{3,}(?: [A-Za-z_]+)*\s*>>
\[\[\s*[A-Za-z_]{3,}\s*\]\](?=[,!.?]|$)
\[(?:First|Last|Full|Your|Company|Customer|User|Club|Event|Store|City)(?: ?[A-Za-z]+)*\]
\[(?:Location|Name|Date|City|Company|Address|Email|Phone|Title|Venue)\]
\[[A-Z]{3,}(?: [A-Za-z]+)*\]
\[INSERT [^\]]*\]
<(?:Enter|Insert|Your|Add|Type)(?: [a-z]+)+>
\bX{3,} [A-Z]+ X{3,}\b
(?<![\w$`/=])\$\{[a-z_]+(?:\.[a-z_]+)*\}(?![/\w`])
(?<!\w)\{\d\}(?: \w+){1,3} \{\d\}
\b__[A-Z]+__\b
\[object Object\]
^(?:NaN|undefined|null) \w+ (?:in stock|reviews)
\bundefined reviews\b
^(?:dear|hi|hello) (?:undefined|null)\b
"""
# Words of text about the notation.
ABOUT = r"""
\b(escape|syntax|template engine|templates?|placeholders?|config|configuration|variable|function|returns?|notation|brackets?|regex|parser|render(?:s|ing)?|docs?|documentation|macro|snippet|bug|printers|as filler)\b
"""
#: Somebody is addressed by the slot itself: then nothing is said about the notation.
GREETING = r"(?:^|[.!?:] )(?:dear|hi|hello|hey|welcome|thanks|thank you|good morning|hallo|liebe[r]?|bonjour|cher|chère|hola|estimad[oa]|ciao|caro|olá|merhaba|здравствуйте|привет|уважаем\w+|你好|您好)\b[^`\"“„]{0,60}$"
CODE = r"""=>|`|;\s*$|^\s*(?:def|const|let|var|for|if|import|export|return|cp|mv|echo|set|print|SELECT|FROM|GROUP|#)\b.*[(){}=;$/]|^\s*(?:cp|mv|echo|cat|rm|ls) |\$\w+ ?=|\)\s*\{"""


# A title that is joined to the message by a blank: one word, or a word "and the" two more.
_TITLE = r"^(?:(?:user|assistant) : )?(?:[\w<*>-]+ (?:and the (?:[\w<*>-]+ ){2,3}?)?)??"


def _any(block: str, flags: int = 0, titled: bool = False) -> re.Pattern:
    if titled:
        return re.compile("|".join(f"(?:{_TITLE}(?:{x[1:]}))" if x[0] == "^" else f"(?:{x})" for x in block.strip().splitlines()), flags)
    return re.compile("|".join(f"(?:{x})" for x in block.strip().splitlines()), flags)


_ERROR, _SCRIPT, _FILL = _any(ERRORS, titled=True), _any(SCRIPTS, titled=True), _any(FILLER, titled=True)
_SLOT, _ABOUT, _CODE, _GREETING = _any(SLOTS, re.M), _any(ABOUT, re.I), re.compile(CODE), re.compile(GREETING, re.I)
_REASON = "|".join(sorted({re.escape(s.phrase.lower().replace("'", " ' ")) for s in HTTPStatus if s >= 400}, key=len, reverse=True))
_STATUS = re.compile(rf"(?:^|\b(?:http|error|code|status) ?:? ?)<num> ?[-:|–—]? ?(?:{_REASON})\b|^(?:http )?(?:{_REASON})(?: \( ?<num> ?\))? ?[.!]?$")


def _words(found: list[str]) -> re.Pattern:
    return re.compile("|".join(rf"\b{re.escape(w)}\b" if w.isascii() else re.escape(w) for w in sorted(found, key=len, reverse=True)))


_PLACE, _FAULT, _SCRIPTED, _WANT, _BROWSER = _words(PLACES), _words(FAULTS), _words(SCRIPT_WORDS), _words(WANTED), _words(BROWSER)
_FILLED = re.compile(rf"\b(?:{'|'.join(FILL)})\b (?:(?:a|an|the|your|our|some|short|brief|main|sub)\b ?)*(?:{'|'.join(FILLED)})\b(?: \w+){{0,3}} (?:{'|'.join(HERE)})\b")
# Further words that the clear wordings rest on.
CLEAR = """error erreur fehler ошибка 错误 forbidden gateway internal unauthorized moved service too|many access|denied zugriff|verweigert accès|refusé acceso|denegado доступ permission connect requested temporarily
overloaded retry oops traceback warning fatal notice parse session expired log|in|again be|back|soon maintenance something|went|wrong rencontré can't|find can’t|find javascript java|script script scripts scripting
скрипт checking|your|browser todo tbd asdf qwer button|label sample|text dummy placeholder body|text caption goes|here in|this|box below answer replace|this to|edit to|add xxxx""".replace("|", " | ").split()


def _cues() -> list[str]:
    words = [w.replace(" | ", " ") for w in " ".join(CLEAR).replace(" | ", "|").split()]
    words = [w.replace("|", " ") for w in words]
    more = [w.replace(" ' ", "'") for w in FAULTS] + SCRIPT_WORDS + [s.phrase.lower() for s in HTTPStatus if s >= 400] + ["lorem ipsum", "headline", "title", "found", "exist", "page", "site", "server", "seite", "página", "страница", "页面", "网页"]
    more += [f"{b} {c}" for b in FILLED for c in HERE] + [w for w in HERE if not w.isascii()]
    return sorted({*words, *more, *(w.replace("'", "’") for w in more if "'" in w)})


CUES = _cues()
#: Tokens that a verdict can rest on; the tree never widens them.
_FIXED = {t for w in [*CUES, *PLACES, *FAULTS, *SCRIPT_WORDS, *WANTED, *BROWSER, *FILL, *FILLED, *HERE, *LATIN] for t in _TOKENS.findall(w.lower())} | {"<num>"}
_automaton: list = []


def cue_search():
    """The automaton over all cue words, built once a process."""
    if not _automaton:
        a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in CUES:
            a.add_word(w)
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def messages(text: str) -> list[str]:
    """The sentences and lines of a text, without quoting marks and blank ones."""
    return [m for m in (x.strip(" \t\u00a0\u3000>*#-\ufeff\u200b") for x in _ENDS.split(text)) if m]


def tokens(message: str) -> list[str]:
    """The message's tokens with numbers masked."""
    return ["<num>" if _NUMBER.match(t) else t for t in _TOKENS.findall(message)]


def pieces(t: list[str]) -> list[list[str]]:
    """A token list as lists of at most MESSAGE_TOKENS that overlap by a third and cover it all."""
    if len(t) <= MESSAGE_TOKENS:
        return [t] if t else []
    return [t[k : k + MESSAGE_TOKENS] for k in range(0, len(t) - MESSAGE_TOKENS // 3, MESSAGE_TOKENS * 2 // 3)]


def leaf_of(t: list[str]) -> str:
    """The path of a token list through the tree: its length, its first DEPTH tokens and its cue tokens in their order."""
    return " ".join([str(len(t)), *t[:DEPTH], "|", *[x for x in t if x.lower() in _FIXED or x.startswith("/")]])


class Leaf:
    """The groups of one leaf: templates of token lists that are alike, with documents and shares of their messages."""

    def __init__(self):
        self.templates: list[list[str]] = []
        self.documents: list[int] = []
        self.shares: list[float] = []
        self.at: dict[tuple[int, str], set[int]] = {}

    def add(self, t: list[str], documents: int, share: float) -> int:
        """The group of a token list; a new one unless one is similar enough, whose template is then widened.

        Only groups that agree in some token outside the leaf's path are compared: others can't be similar enough.
        """
        best, score = -1, -1.0
        near: dict[int, int] = {}
        for k, x in enumerate(t):
            for g in self.at.get((k, x), ()):
                near[g] = near.get(g, 0) + 1
        for g, n in near.items():
            if n / len(t) > score:
                best, score = g, n / len(t)
        if best >= 0 and score >= SIMILAR:
            for k, (a, b) in enumerate(zip(self.templates[best], t)):
                if a != b and a != WILD:
                    self.at[k, a].discard(best)
                    self.templates[best][k] = WILD
            self.documents[best] += documents
            self.shares[best] += share * documents
            return best
        g = len(self.templates)
        self.templates.append(list(t))
        self.documents.append(documents)
        self.shares.append(share * documents)
        for k, x in enumerate(t):
            self.at.setdefault((k, x), set()).add(g)
        return g


def classify(template: str, documents: int = 1, share: float = 0.0) -> str | None:
    """error, script or filler for a template that is such a text; None for an ordinary one.

    documents is the number of documents with the template, share the part of them it makes up on average.
    """
    t = template.lower()
    if _ERROR.search(t) or _STATUS.search(t):
        return "error"
    if _SCRIPT.search(t):
        return "script"
    if _FILL.search(t):
        return "filler"
    n = t.count(" ") + 1
    if TOLD.search(t) or n > 3 * SHORT:
        return None
    # weak wording: what recurs, fills its documents, has slots, or is a short notice to the reader
    evidence = (documents >= RECURS) + (share >= SHARE) + (WILD in t) + (n <= SHORT)
    if _SCRIPTED.search(t) and _WANT.search(t) and evidence + 2 * bool(_BROWSER.search(t)) >= 3:
        return "script"
    if _FAULT.search(t) and _PLACE.search(t) and evidence >= 2 - (n <= 8):
        return "error"
    if _FILLED.search(t) and evidence >= 1 or n >= 4 and sum(x in LATIN for x in t.split()) * 2 >= n:
        return "filler"
    return None


def unresolved(message: str) -> bool:
    """Whether a message holds an unresolved slot, and neither is code nor talks about the notation."""
    m = _SLOT.search(message)
    if not m or _CODE.search(message):
        return False
    return bool(_GREETING.search(message[: m.start()])) or not _ABOUT.search(_SLOT.sub(" ", message))


_MINED = "doc_id bigint, message bigint, leaf string, text string, share double, slot boolean"


def _read(batches):
    """Messages with a cue: document, the message's hash, its leaf, its tokens and its share of the text; and slots."""
    search = cue_search()
    for batch in batches:
        rows: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low = text.lower()
            cued = next(search.iter(low), None) is not None
            slotted = any(c in text for c in "{[<%_") or "XXX" in text or "undefined" in low or "NaN" in text or "null" in low
            if not cued and not slotted:
                continue
            seen = set()
            slot = False
            for m in messages(text):
                if slotted and not slot and (any(c in m for c in "{[<%_X") or "undefined" in m or "NaN" in m or "null" in m):
                    slot = unresolved(m)
                if cued and next(search.iter(m.lower()), None) is not None:
                    for t in pieces(tokens(m)):
                        name = " ".join(t)
                        if name not in seen:
                            seen.add(name)
                            rows.append((i, xxhash.xxh64_intdigest(name) - (1 << 63), leaf_of(t), name, len(m) / len(text), False))
            if slot:
                rows.append((i, 0, None, None, 0.0, True))
        yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "message", "leaf", "text", "share", "slot"), r)) for r in rows], schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("message", pa.int64()), ("leaf", pa.string()), ("text", pa.string()), ("share", pa.float64()), ("slot", pa.bool_())])
_GROUPED = pa.schema([("message", pa.int64()), ("part", pa.string()), ("template", pa.string()), ("documents", pa.int64()), ("share", pa.float64())])


def _grow(batches):
    """Rows sorted by leaf become groups: (message, part) for every message, (part, template, documents, share) for every group."""
    leaf, now = None, Leaf()

    def ended():
        return [{"message": None, "part": f"{leaf} #{g}", "template": " ".join(t), "documents": n, "share": s / max(n, 1)} for g, (t, n, s) in enumerate(zip(now.templates, now.documents, now.shares))]

    for batch in batches:
        out = []
        for key, message, text, n, share in zip(*[c.to_pylist() for c in batch.columns]):
            if key != leaf:
                out += ended()
                leaf, now = key, Leaf()
            g = now.add(text.split(" "), n, share)
            out.append({"message": message, "part": f"{leaf} #{g}", "template": None, "documents": None, "share": None})
        yield pa.RecordBatch.from_pylist(out, schema=_GROUPED)
    yield pa.RecordBatch.from_pylist(ended(), schema=_GROUPED)


def _verdicts(batches):
    for b in batches:
        kinds = [classify(t, n, s) for t, n, s in zip(b.column("template").to_pylist(), b.column("documents").to_pylist(), b.column("share").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("template"), b.column("documents"), b.column("share"), pa.array(kinds, type=pa.string())], names=["part", "template", "documents", "share", "kind"])


def mined(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents' messages with a cue (and slots), the messages' groups, and the groups' templates with their verdicts."""
    narrow = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    read = cut(narrow.mapInArrow(_read, _MINED), "messages")
    counted = read.where("not slot").groupBy("leaf", "message").agg(F.first("text").alias("text"), F.count("*").alias("documents"), F.avg("share").alias("share"))
    stream = counted.repartition("leaf").sortWithinPartitions("leaf", F.desc("documents"), "message").select("leaf", "message", "text", "documents", "share")
    grown = cut(stream.mapInArrow(_grow, "message bigint, part string, template string, documents bigint, share double"), "groups")
    told = grown.where("template is not null").select("part", "template", "documents", "share").mapInArrow(_verdicts, "part string, template string, documents bigint, share double, kind string")
    return read, grown.where("message is not null").select("message", "part"), told


def residue_templates(df: DataFrame, key: str, text: str) -> DataFrame:
    """template, documents, share, kind of every mined template that is residue."""
    return mined(df, key, text)[2].where("kind is not null").drop("part")


def residue_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and kinds (sorted: error, filler, script, slot) of every document with left-over text.

    Null keys, null, empty and blank texts have none. Rows that repeat a key count once. Texts are read whole; long
    messages enter the tree as overlapping pieces. An empty table gives an empty result; other columns are ignored.
    """
    read, groups, told = mined(df, key, text)
    kinds = groups.join(told.where("kind is not null").select("part", "kind"), "part").select("message", "kind")
    found = read.where("not slot").select("doc_id", "message").join(kinds, "message").select("doc_id", "kind")
    slots = read.where("slot").select("doc_id", F.lit("slot").alias("kind"))
    return found.unionByName(slots).groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
