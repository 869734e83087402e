"""Template residue and error-page text: a linear classifier on hashed n-grams over the lines and sentences of a text.

A text is read as paragraphs of units (sentences, or lines of lists and fields), after code and quotations are set
aside. Weak labels come from response-status and phrase patterns (`weak_label`); on a bounded sample of the units, and on
the seeds of `seeds.py` (status phrases, notices, template fields and short notes put together by rule), a regularised softmax
model of four classes is fitted: clean, slot (an unfilled placeholder), filler and notice (error, access, maintenance, sign-in
and script notices). The model alone gives the verdicts; the patterns only label its sample.

Its features are hashed word n-grams; for anything that stands between brackets or signs, the signs, the case, the number and
the kind of its words (`_described`), so that a placeholder is told by how it is made and not by a list of spellings; and the
unit's length, repetition, names, and place after a title. These last ones say little of their own: features are dropped at
random in training, and clean units, often down to no known word, so what the model knows nothing of is clean. A class other
than clean needs a probability of SURE.

A document is residue if any unit is a slot, if at least three of five units of a paragraph are filler, or if at least half of
its body - what is left without title, menu and footer - is notice.

Defined cases: null and blank texts are no residue; a text of code or quotations only has no units and is none; doc_ids
may repeat and be null; placeholders are read up to 60 characters; without documents the result is empty.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.seeds import seeds
from stratamem.sources.tables import spread

CLASSES = ("clean", "slot", "filler", "notice")
BUCKETS = 1 << 20
SHAPED = 1 << 10  # the first buckets: features of length and place
SURE = 0.65
FIT_DOCS = 20_000  # the largest number of documents the sample of units is drawn from
FIT_UNITS = 50_000  # the largest number of their units the model is fitted on
LONG_BODY, ONE_IN = 8, 4  # of longer bodies one plain unit in so many is labelled for the sample
HELD_OUT_HOSTS = 5  # in validation, one host in so many is not trained on
KNOWN_WORDS = 300_000  # kept in each Python worker
DOCS_AT_ONCE = 500

# Phrases and shapes that weak labels are made of, and how texts are parted.
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_OPENS = re.compile(r"<(pre|code|script|style|head|title|nav|footer)\b[^<>]*>", re.I)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"(?<!\w)'[^'\n]+'(?!\w)|\"[^\"\n]+\"|“[^“”„\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|‘[^‘’\n]*’")
_TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|hr|br|div|p|span|noscript|center|main|section|article|ul|ol|li|table|tr|td|th|a|b|i|em|strong|header|footer|nav|form|button|meta|link|img)\b(?:\s[^<>]*)?/?>|<!doctype[^>]*>", re.I | re.S)
_LINK_SLOT = re.compile(r"<(?:title|link|label|code|summary|time|a|b|i|form|table|button|header|footer)>", re.I)
_SLOT = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%=?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|\[(?:your|insert|enter|add|put|ihr|dein|votre|su|tu)\b[^\[\]\n]{0,60}\]|\{[A-Za-z_][\w .-]{0,40}\}|\{\d{1,2}\}|(?<![\w%])%[A-Z][A-Z_]{1,40}%|(?<!\w)__[A-Z][A-Z_]{0,40}__(?!\w)"
    r"|(?<![\w<])<[A-Za-z][A-Za-z_ ]{0,40}>(?!\w)|(?<!\w)%\([a-z_]+\)s", re.I)
_EMPTY = r"(?:tbd|tba|todo|n/?a(?: yet)?|none yet|to be (?:filled in|defined|done|added|decided)|<?(?:empty|none|missing)>?|\.\.\.+|…|-+|_+|\?+|xxx+|lorem.*|placeholder)"
_FIELD = re.compile(rf"^[-*]?\s*\**[A-Za-z][\w ]{{0,30}}\**\s*[:=]\s*{_EMPTY}\s*$", re.I)
_FILLER = re.compile(
    r"lorem ipsum|dolor sit amet|consectetur|platzhaltertext|blindtext|texto de relleno|texte de remplissage|faux[- ]texte|texto de ejemplo|texte (?:d'exemple|provisoire|factice)|contenu à venir"
    r"|(?:insert|add) (?:content|text) here|your text (?:goes )?here|(?:sample|dummy|filler|placeholder) (?:text|content)|text to be (?:written|added)|example (?:heading|sentence)|content (?:coming soon|goes here)|body copy to follow|^(?:#+ )?replace this (?:paragraph|text|sentence|section|heading)|^(?:add|write|insert|enter) (?:a|your|the) (?:description|summary|title|text|note)\b.{0,30}(?:here|for this \w+)?\.?$", re.I)
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_SCRIPT = r"(?:java ?script|js|scripts?|scripting|client-side code|cookies)"
_NOTICE = re.compile(
    rf"^(?:please |kindly |you must |you need to )?(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b|^(?:your|this) (?:browser|app|site|page|application|content|view)\b.{{0,80}}\b{_SCRIPT}\b|^{_SCRIPT} (?:is|are|seems|must|appears|has|was)\b.{{0,40}}\b(?:disabled|off|required|needed|blocked|enabled)"
    rf"|^(?:sorry|we're sorry|oops)\b.{{0,80}}\b{_SCRIPT}\b|^.{{0,60}}\b(?:requires?|needs?|without) {_SCRIPT}\.?$"
    r"|^(?:bitte )?(?:aktivieren|schalten) sie .{0,40}javascript|javascript eingeschaltet sein|^ihr browser (?:blockiert|unterstützt)|^(?:active[rz]?|activa|habilit[ae]|veuillez activer)\b.{0,40}javascript|a besoin de scripts|necesita javascript|nécessite javascript"
    r"|^(?:http )?(?:error |status |fehler |erreur )?[45]\d\d\b(?:[ :.-]+(?:[A-Z][a-z]+|$)|\.)|^error [45]\d\d\b|\b(?:not found|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|unauthorized|forbidden|bad request)\b\W*$"
    r"|^\W{0,5}\{\W{0,5}\"?(?:error|status|code|message)\"?\W(?!\W{0,3}null\b)|^access (?:is |to .{1,40} )?(?:denied|forbidden)|^you (?:do not|don't) have (?:permission|access)|^permission denied"
    r"|^(?:your |the )?(?:session|login|token) (?:has |is )?(?:expired|timed out)\b(?! \w)|^(?:please )?(?:log|sign) in (?:to|again|first)|^you (?:must|need to|have to) (?:be (?:logged|signed) in|log in|sign in)"
    r"|^(?:the |this )?[\w' -]{1,30} (?:is|are) (?:currently |temporarily )?(?:down|closed|offline|unavailable)\b|(?:down|closed) for (?:scheduled )?maintenance|^(?:under|scheduled) maintenance|^we (?:are|will be) (?:back|performing|down)"
    r"|^too many (?:attempts|requests)|^wait a (?:few|moment)|^(?:please )?try again|^verify (?:that )?you are|^checking (?:the |your )?(?:connection|browser)|^unable to (?:fetch|load|reach|open|connect|render|display|show)|^(?:could|can) ?not (?:load|reach|fetch|connect|be)"
    r"|^change the setting|^(?:then )?reload\b|^(?:please )?(?:use the search|ask the owner|go back|come back|check again|check back|contact support|log in|return to)\b.{0,40}$|^no output$|^our team has been|(?:is|are) over capacity|^(?:oops|whoops|sorry)\W*$|^check the (?:address|link|url|spelling)\b|will be back soon|(?:cannot|could not) be (?:shown|displayed|served|found|loaded|reached|opened)\W*$|(?:is not|isn.t) available right now|no longer exists|has (?:been )?moved\.?$"
    r"|^(?:es ist ein fehler|ein fehler ist|une erreur|se ha producido un error|ha ocurrido un error)|^bitte (?:versuchen sie|anmelden|melden sie)|^veuillez (?:réessayer|vous connecter)|^connectez-vous|^(?:inicia|inicie) sesión|^(?:vuelva|intente|inténtelo|inténtalo)\b|^(?:esta|cette|diese) .{0,30}(?:necesita|nécessite|benötigt|a besoin)"
    r"|\btimed out after\b|\brefused the connection\b|\(trace \w+\)|^(?:fatal|uncaught|unhandled|traceback|exception|typeerror|referenceerror|panic)\b|^\w*error:|\bsomething (?:went wrong|broke|failed|is (?:wrong|broken|not (?:right|working)))\b|an (?:unexpected )?error (?:has )?occurred"
    r"|(?:page|seite|site|página|view|document|resource) (?:you .{1,30} )?(?:not found|nicht gefunden|non trouvée|introuvable|no encontrada|has moved|does not exist|no longer exists)|^página no encontrada|^page introuvable|^seite nicht gefunden|^die seite .{0,40}(?:nicht|existiert)|^zugriff verweigert|^accès refusé|^acceso denegado|^(?:votre|su|ihre) (?:session|sesión|sitzung)\b|wartung|en maintenance|en mantenimiento", re.I)
_CHROME = re.compile(
    r"^(?:#+ .*|[\w-]+(?:/[\w-]+)+|retry|close|ok|go back|reload|return to .{1,30}|back to top|status page|reference\b.{0,20}|request id\b.{0,30}|(?:contact|terms|imprint|privacy|home|menu|login|sign in|sign up|help|search|notes|explore|namespaces|about|impressum|datenschutz|kontakt|suche|hilfe|accueil|inicio|©.*)(?: \w{1,10}+)?(?:(?: {2,}+|\s*+[|·•>\t]\s*+)[\w-]{1,14}+(?: [\w-]{1,14}+){0,2}){0,9}|volver al inicio|zurück.{0,20}|retour.{0,20})[.\s]*$", re.I)
_QUOTES, _MARK = re.compile("['\"“„«‘]"), re.compile(r"[{<\[%_@#$~^|=+!?]")
_TAIL = re.compile(r"(?<=\S)\s+(?:retry|close|status page|back to top|reload|reference \w{4,10})\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[^\s\d])|\n+")
_LONG = re.compile(r".{1,4000}(?:\s|\Z)|.{1,4000}", re.S)  # what has no sentence ends is read in stretches
_TITLE = re.compile(r"^[^.!?:{}<>%$\[\]|]{3,80}$")
_FIELD_NAME = re.compile(r"^[-*]?\s*\**[\w ]{1,30}\**\s*[:=]")
# Anything between brackets, or between signs that repeat in reverse; whether it is a placeholder is for the model to say.
_WRAP = re.compile(
    r"[$#%@]?\{{1,3}[^{}\n]{1,60}\}{1,3}|\[{1,3}[^\[\]\n]{1,60}\]{1,3}(?!\()|<{1,3}[^<>\n]{1,60}>{1,3}|%\([A-Za-z_]\w{0,40}\)[sd]|\({2}[^()\n]{1,60}\){2}"
    r"|(?<![\w@#%$~^|!?=+])([@#%$~^|!?=+]{1,3})[A-Za-z][\w.-]{0,40}?\1(?![\w@#%$~^|!?=+])|(?<!\w)(_{2,3})[A-Za-z]\w{0,40}?\2(?!\w)|(?<!\w)([A-Z]{2,4})_[A-Z][A-Z_]{0,40}?_\3(?!\w)")
_ANY = re.compile(r"[^\W_]")
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_TOKEN = re.compile(r"⟨[^⟩]*⟩|[^\W\d_]+|\d+|\.\.\.+|…|[{}<>%$\[\]|:=?!\x00]")


def _without_blocks(text: str, names: tuple[str, ...], mark: str) -> str:
    """The text with elements of these names replaced by a mark, in one pass; an element that is never closed stays."""
    lower, ends, out, at = text.lower(), {}, [], 0
    for m in _OPENS.finditer(text):
        name = m.group(1).lower()
        if m.start() < at or name not in names:
            continue
        if name not in ends:
            ends[name] = [e.start() for e in re.finditer(rf"</{name}>", lower)]
        i = bisect_left(ends[name], m.end())
        if i < len(ends[name]):
            out += [text[at : m.start()], mark]
            at = ends[name][i] + len(name) + 3
    return "".join([*out, text[at:]])


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], "\n"]
        at = b + 3
    return "".join([*out, text[at:]])


def paragraphs(text: str) -> list[list[str]]:
    """The units of each paragraph. Markup is dropped where it encloses text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if any(unicodedata.category(c) == "Cf" for c in set(text)):
            text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n⟨code⟩\n\n", text)
    angle = "<" in text
    if angle:
        text = _without_blocks(text, ("pre", "code", "script", "style"), "\n\n⟨code⟩\n\n")
    if "`" in text:
        text = _INLINE.sub("⟨code⟩", text)
    if re.match(r"\s*[\[{]", text) and not re.match(r"\s*(?:\{\W*\"?error|\{\{|\[\[|\{%)", text, re.I) and text.rstrip()[-1:] in "]}" and '"' in text:
        return []
    if angle:
        marked = bool(re.search(r"</\w+>", text))
        if marked:
            text = _without_blocks(_without_comments(text), ("head", "title", "nav", "footer"), "\n")
        text = _TAG.sub(lambda m: m.group() if not marked and _LINK_SLOT.fullmatch(m.group()) else "\n", text)
    out = []
    for block in re.split(r"\n[ \t]*\n\s*", text):
        units = [u.strip() for s in _SENTENCE.split(block) if s for u in ((s,) if len(s) <= 4000 else _LONG.findall(s)) if u.strip(" \t\n>*-")]
        if units:
            out.append(units)
    return out


def _unquoted(unit: str) -> str:
    return _QUOTE.sub("⟨quote⟩", unit) if _QUOTES.search(unit) and not unit.lstrip().startswith("{") else unit


def _wrapped(unit: str) -> bool:
    """Whether anything outside quotations stands between brackets or signs."""
    return bool(_MARK.search(unit)) and bool(_WRAP.search(_unquoted(unit)))


def weak_label(unit: str) -> str | None:
    """The class that patterns give a unit; None where they do not say (chrome: title, menu and footer lines)."""
    u = _unquoted(unit)
    if "⟨code⟩" in u and not _SLOT.search(u):
        return "clean"
    if _FIELD.match(u):
        return "filler"
    if _SLOT.search(u):
        return "slot"
    w = re.findall(r"[^\W\d_]+", u.lower())
    if _FILLER.search(u) or (len(w) >= 4 and sum(x in _LATIN for x in w) > 0.8 * len(w)) or (len(w) >= 6 and len(set(w)) <= max(2, len(w) // 5)):
        return "filler"
    if _NOTICE.search(u.strip(" #*>-")):
        return "notice"
    return None if _CHROME.match(u) else "clean"


def _phrases(unit: str) -> str:
    """The unit without what the patterns label it by."""
    u = _unquoted(unit)
    return _NOTICE.sub(" ", _FILLER.sub(" ", _SLOT.sub(" ", u)).strip(" #*>-"))


def _described(m: re.Match) -> str:
    """What stands between brackets or signs, as words about it."""
    t = m.group()
    core = t.strip("{}[]<>()%@#$~^|!?=+_-/*. ") or t
    if (x := m.group(3)) is not None:
        core = core.removeprefix(x).removesuffix(x).strip("_")
    signs = t[: t.find(core)].strip() or "none"
    parts = _PART.findall(core)
    case = "upper" if core.isupper() else "lower" if core.islower() else "title" if core.istitle() else "camel" if len(parts) > 1 and " " not in core else "mixed" if any(c.isalpha() for c in core) else "plain"
    glue = "_" if "_" in core else "dot" if re.search(r"\w[.-]\w", core) else "blank" if " " in core else "none"
    sums = "odd" if re.search(r"[^\w .:|'-]", core) else "even"
    kind = f"{case}:{min(len(parts), 4)}:{glue}:{sums}"
    signs = "XX_" if m.group(3) else signs
    return " " + " ".join(f"⟨{x}⟩" for x in ("wrap", f"o:{signs}", f"p:{signs[0]}:{len(signs) > 1}", f"k:{kind}", f"ok:{signs[0]}:{kind}", *(f"c:{p.lower()}" for p in parts[:6] if not p.isdigit()), f"digits:{any(p.isdigit() for p in parts)}")) + " "


class Words(dict):
    """Tokens to numbers: a hash above three bits for a capital, a word of the Latin filler and a mark of `_described`."""

    def __missing__(self, token: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        mark = token[0] == "⟨"
        word = token if mark else "9" * min(len(token), 4) if token.isdigit() and not (len(token) == 3 and token[0] in "45") else token.lower()
        h = zlib.crc32(word.encode()) | zlib.crc32(word.encode(), 77) << 28
        self[token] = n = (h << 3 | (token[0].isupper() and not token.isupper()) | (word in _LATIN) << 1 | mark << 2) & 0x7FFFFFFFFFFFFFFF
        return n


_SEP = "\x00"


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (SHAPED + ((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS - SHAPED))).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(units: list[tuple[str, str]], known: Words, parted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(unit number, feature) of many units at once, each pair once, in order of the units. The second part of a unit is its place: alone,
    first or later. `parted`: units come as they stand in a text; else they are ready for tokenising."""
    texts = [_unquoted(u) if parted else u for u, _ in units]
    texts = [_WRAP.sub(_described, u) if _MARK.search(u) else u for u in texts]
    got = np.fromiter(map(known.__getitem__, _TOKEN.findall(_SEP.join(texts))), np.int64)
    ends = got == known[_SEP]
    unit, got = np.cumsum(ends)[~ends], got[~ends].astype(np.uint64)
    h, n = got >> np.uint64(3), len(units)
    count = np.bincount(unit, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    place = np.arange(len(unit)) - first[unit]
    at, out = [unit], [_mixed(h, 1)]
    two = np.flatnonzero(unit[1:] == unit[:-1])
    pair = h[two] * np.uint64(31) + h[two + 1]
    three = np.flatnonzero(unit[2:] == unit[:-2])
    for own, x, kind in ((two, pair, 2), (three, (h[three] * np.uint64(31) + h[three + 1]) * np.uint64(31) + h[three + 2], 3)):
        at.append(unit[own])
        out.append(_mixed(x, kind))
    for own, kind in ((place[two] == 0, 4), (place[two] + 2 == count[unit[two]], 5)):  # the first and the last two words
        at.append(unit[two[own]])
        out.append(_mixed(pair[own], kind))
    ones = (place == 0) & (count[unit] == 1)
    at.append(unit[ones])
    out.append(_mixed(h[ones], 6))
    field = np.array([bool(_FIELD_NAME.match(u)) for u, _ in units], bool)
    short = field[unit] & (count[unit] < 8) & (place >= count[unit] - 2)
    at.append(unit[short])
    out.append(_mixed(h[short], 7))
    seen = lambda bit: np.bincount(unit, (got >> np.uint64(bit)) & np.uint64(1), minlength=n)
    kinds = np.bincount(_distinct((unit << 40) + (h % np.uint64(1 << 40)).astype(np.int64)) >> 40, minlength=n) / np.maximum(count, 1)
    where = np.array([("alone", "first", "later").index(w) for _, w in units], np.int64)
    shape = [np.full(n, 0), 1 + np.minimum(count, 40) // 4, 20 + (kinds * 5).astype(np.int64), 30 + np.minimum(seen(0), 3).astype(np.int64), 40 + (4 * seen(1) / np.maximum(count, 1)).astype(np.int64), 50 + field, 60 + where]
    at += [np.arange(n)] * len(shape)
    out += [np.asarray(x, np.int64) for x in shape]
    both = _distinct(np.concatenate(at).astype(np.int64) * BUCKETS + np.concatenate(out))
    return both // BUCKETS, both % BUCKETS


def _body(paras: list[list[str]]) -> list[tuple[int, str]]:
    """The units with their paragraph, without title, path, menu and footer lines."""
    units = [(k, _TAIL.sub("", u) if len(u) < 4000 else u) for k, p in enumerate(paras) for u in p]
    chrome = lambda i, u: (len(u) <= 600 or u[0] == "#") and bool(_CHROME.match(u)) or (i == 0 and len(units) > 1 and _TITLE.match(u) and not _NOTICE.search(u))
    return [(k, u) for i, (k, u) in enumerate(units) if not chrome(i, u) or _wrapped(u)] or units


def _where(i: int, n: int) -> str:
    return "alone" if n == 1 else "first" if i == 0 else "later"


def fit(rows: list[np.ndarray], y: np.ndarray, rounds: int = 8, rate: float = 0.3, decay: float = 1e-4, drop: float = 0.25, bare: float = 0.2, seed: int = 5) -> np.ndarray:
    """Softmax weights (BUCKETS, classes) by AdaGrad with L2 decay; rare classes count up to ten times. In each round a share `drop` of the
    features is left out, and of a share `bare` of the clean rows most. Features of a single row have no weight."""
    share = np.bincount(y, minlength=len(CLASSES)) / max(1, len(y))
    weight = np.clip(0.5 / np.maximum(share, 1e-9), 1, 10)[y]
    lens, flat = np.array([len(r) for r in rows]), np.concatenate(rows)
    flat = np.where((np.bincount(flat, minlength=BUCKETS)[flat] > 1) | (flat < SHAPED), flat, 0)
    names, flat = np.unique(flat, return_inverse=True)
    content, ends = names[flat] >= SHAPED, np.cumsum(lens)
    w, g2, rng = np.zeros((len(names), len(CLASSES))), np.full((len(names), len(CLASSES)), 1e-2), np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 256):
            some = order[b : b + 256]
            at = np.concatenate([np.arange(ends[i] - lens[i], ends[i]) for i in some])
            of = np.repeat(np.arange(len(some)), lens[some])
            out = np.where((y[some] == 0) & (rng.random(len(some)) < bare), 0.9, drop)[of]
            kept = ~content[at] | (rng.random(len(at)) >= out)
            idx, of = flat[at[kept]], of[kept]
            z = np.stack([np.bincount(of, w[idx, c], minlength=len(some)) for c in range(len(CLASSES))], 1)
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(some)), y[some]] -= 1
            d *= weight[some][:, None] / len(some)
            u, back = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(back, d[of, c], minlength=len(u)) for c in range(len(CLASSES))], 1) + decay * w[u]
            g2[u] += grad**2
            w[u] -= rate * grad / np.sqrt(g2[u])
    out = np.zeros((BUCKETS, len(CLASSES)), np.float32)
    out[names] = w
    return out


def scored(at: np.ndarray, idx: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """The class number of each of n units: the likeliest one if it is clean or likely enough, else clean."""
    z = np.stack([np.bincount(at, w[idx, c], minlength=n) for c in range(len(CLASSES))], 1)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return np.where(p[np.arange(n), best] >= SURE, best, 0)


def classify(units: list[tuple[str, str]], w: np.ndarray, known: Words) -> np.ndarray:
    """The class number of each unit; one of code and quotations only is clean."""
    only = np.array([("⟨code⟩" in u or bool(_QUOTES.search(u))) and not _ANY.search(re.sub("⟨(?:code|quote)⟩", "", _unquoted(u))) for u, _ in units], bool)
    return np.where(only, 0, scored(*features(units, known), len(units), w))


def verdict(body: list[tuple[int, str]], kinds: list[str | None]) -> str | None:
    """The kind of residue of a document from the classes of its body's units, in order."""
    if "slot" in kinds:
        return "slot"
    by: dict[int, list] = {}
    for (k, _), kind in zip(body, kinds):
        by.setdefault(k, []).append(kind)
    if any(v.count("filler") >= max(1, 0.6 * len(v)) for v in by.values()):
        return "filler"
    return "notice" if kinds and kinds.count("notice") >= 0.5 * len(kinds) else None


def _rows(at: np.ndarray, idx: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(idx, np.searchsorted(at, np.arange(1, n)))


def _seed_rows(known: Words, held: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    texts = [(t, c, w) for t, c in seeds() for w in ("alone", "later")]
    units = [(_phrases(t) if held else t, w) for t, _, w in texts]
    return _rows(*features(units, known), len(units)), np.array([CLASSES.index(c) for _, c, _ in texts])


def _beginning(unit: str, words: int) -> str | None:
    """The first words of a longer unit, as clean as the whole and as short as a note; None if markup or signs are among them."""
    m = re.match(rf"(?:\w[\w'’-]*,? ){{{words}}}", unit)
    return m.group().strip() + "." if m and m.end() < len(unit) else None


def sample(docs: DataFrame, n: int) -> DataFrame:
    """Weakly labelled units (host, unit, place, label) of at most FIT_DOCS documents, at most FIT_UNITS; rare classes first. Of bodies of
    more than LONG_BODY units, one plain unit in ONE_IN is labelled."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, FIT_DOCS / max(1, n)) * (1 << 20)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, host in zip(pdf["doc_id"], pdf["text"], pdf["source"]):
                body = _body(paragraphs(text)) if text and text.strip() else []
                for i, (_, u) in enumerate(body):
                    spread = zlib.crc32(f"{doc}:{i}".encode())
                    if len(body) > LONG_BODY and spread % ONE_IN and not _MARK.search(u):
                        continue
                    if label := weak_label(u):
                        rows.append((host, u, _where(i, len(body)), CLASSES.index(label), spread if label == "clean" else spread // 16))
                        if label == "clean" and spread % 3 == 0 and (begin := _beginning(u, 3 + spread % 7)):
                            rows.append((host, begin, "alone", 0, spread))
            yield pd.DataFrame(rows, columns=["host", "unit", "place", "label", "spread"])

    drawn = spread(some.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")).mapInPandas(run, "host string, unit string, place string, label int, spread long")
    return drawn.orderBy("spread", "unit", "place").limit(FIT_UNITS).drop("spread")


def _host_part(host: str | None) -> int:
    return zlib.crc32((host or "").encode()) % HELD_OUT_HOSTS


REPORT = "features string, class string, n long, precision double, recall double"


def train(docs: DataFrame, validate: bool = True) -> tuple[np.ndarray, DataFrame]:
    """The weights, fitted on the whole sample and the seeds, and the validation (features, class, n, precision, recall) of weights
    fitted without the held-out hosts, on those hosts: with all features, and with the phrases that labels are given by
    held out of training and test."""

    def given(pdf: pd.DataFrame, blind: bool) -> list[np.ndarray]:
        units, known, out = [(_phrases(u) if blind else u, w) for u, w in zip(pdf["unit"], pdf["place"])], Words(), []
        for a in range(0, len(units), 5_000):
            out += _rows(*features(units[a : a + 5_000], known, not blind), len(units[a : a + 5_000]))
        return out

    def scores(pdf: pd.DataFrame, blind: bool, name: str) -> list[tuple]:
        rows, y = given(pdf, blind), pdf["label"].to_numpy()
        held = pdf["host"].map(_host_part).to_numpy() == 0
        if not held.any():
            return []
        more, classes = _seed_rows(Words(), blind)
        w = fit([r for r, h in zip(rows, held) if not h] + more, np.concatenate([y[~held], classes]))
        test, y = [r for r, h in zip(rows, held) if h], y[held]
        p = scored(np.repeat(np.arange(len(test)), [len(r) for r in test]), np.concatenate(test), len(test), w)
        return [(name, c, int((y == k).sum()), float(((y == k) & (p == k)).sum() / max(1, (p == k).sum())), float(((y == k) & (p == k)).sum() / max(1, (y == k).sum()))) for k, c in enumerate(CLASSES)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        more, classes = _seed_rows(Words())
        w = fit(given(pdf, False) + more, np.concatenate([pdf["label"].to_numpy(), classes]))
        used = np.flatnonzero(w.any(1))
        table = [t for blind, name in ((False, "all"), (True, "without the labels' phrases")) for t in scores(pdf, blind, name)] if validate else []
        return pd.DataFrame({"at": [used.astype(np.int32).tobytes()], "w": [w[used].tobytes()], "scores": [[dict(zip(("features", "class", "n", "precision", "recall"), t)) for t in table]]})

    shape = "at binary, w binary, scores array<struct<features: string, class: string, n: long, precision: double, recall: double>>"
    got = sample(docs, docs.count()).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, shape).collect()
    w = np.zeros((BUCKETS, len(CLASSES)), np.float32)
    if got:
        w[np.frombuffer(bytes(got[0]["at"]), np.int32)] = np.frombuffer(bytes(got[0]["w"]), np.float32).reshape(-1, len(CLASSES))
    return w, docs.sparkSession.createDataFrame(got[0]["scores"] if got else [], REPORT)


def residue(docs: DataFrame, labels: bool = False) -> DataFrame:
    """doc_id and kind (slot, filler, notice) of the documents that hold residue. docs: doc_id, text, source. With `labels`
    also those that the weak labels alone would give, and what each says: kind and by_labels."""
    w, _ = train(docs, validate=False)
    one = docs.sparkSession.sparkContext.broadcast(w)  # BUCKETS x 4 weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known = one.value, Words()
        for pdf in batches:
            for a in range(0, len(pdf), DOCS_AT_ONCE):
                part = pdf.iloc[a : a + DOCS_AT_ONCE]
                bodies = [_body(paragraphs(t)) if t and t.strip() else [] for t in part["text"]]
                units = [(u, _where(i, len(b))) for b in bodies for i, (_, u) in enumerate(b)]
                kinds, at, rows = [CLASSES[c] for c in classify(units, w, known)] if units else [], 0, []
                for doc, b in zip(part["doc_id"], bodies):
                    kind = verdict(b, kinds[at : at + len(b)])
                    at += len(b)
                    own = verdict(b, [weak_label(u) or "chrome" for _, u in b]) if labels else None
                    if kind or own:
                        rows.append((doc, kind, own))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "kind", "by_labels"])

    named = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    found = named.mapInPandas(run, "doc_id string, kind string, by_labels string").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return found if labels else found.drop("by_labels")
