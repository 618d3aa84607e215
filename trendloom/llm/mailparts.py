"""The parts of a stored mail as a mail program shows them to a reader."""

from __future__ import annotations

import binascii
import html
import re
from quopri import decodestring

_HEADER_LINE = re.compile(r"(?:From |[!-9;-~]+[ \t]*:)")
_BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n|\r?\n\Z")
_FOLDING = re.compile(r"\r?\n(?=[ \t])")
_PARAM = re.compile(r";\s*([\w*-]+)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^\s;]*))")

# Elements of HTML that a browser sets apart from the text around them.
_APART = "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html img input legend li main nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul video"
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|title|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_HIDDEN = re.compile(r"<(\w+)\b[^>]*?(?:display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?=[\s>/=]))[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<![^>]*>|<\?[^>]*>")
_SET_APART = frozenset(_APART.split())


def html_text(source: str) -> str:
    """The text that an HTML body shows: no tags, comments or hidden elements, entities resolved.

    Elements that stand apart end a word, inline ones don't.
    """
    if "<" in source:
        source = _UNSEEN.sub(" ", source)
        source = _HIDDEN.sub(" ", source)
        source = _TAG.sub(lambda m: "\n" if m[2] and m[2].lower() in _SET_APART else "", source)
    return html.unescape(source) if "&" in source else source


def _headers(block: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in _FOLDING.sub(" ", block).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _split(entity: str) -> tuple[dict[str, str], str]:
    """Headers and body; an entity that starts with a blank line has no headers."""
    if entity[:1] == "\n" or entity[:2] == "\r\n":
        return {}, entity
    m = _BLANK_LINE.search(entity)
    if m is None:
        return _headers(entity), ""
    return _headers(entity[: m.start()]), entity[m.end() :]


def _params(value: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _PARAM.finditer(value)}


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/]", "", body.partition("=")[0] if "=" in body.rstrip().rstrip("=") else body)
        data = binascii.a2b_base64(raw[: len(raw) - (len(raw) % 4 == 1)] + "=" * (-len(raw) % 4 if len(raw) % 4 != 1 else 0))
    elif encoding == "quoted-printable":
        # characters beyond ASCII don't belong here; they are kept as they are
        data = decodestring(body.encode("utf-8", "surrogatepass"))
        if not body.isascii():
            charset = "utf-8"
    else:
        return body
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _multipart(body: str, boundary: str) -> list[str] | None:
    """The entities between the boundary's lines; the last may lack its end. None if no line is one."""
    line = "--" + boundary
    entities, begun, at = None, 0, body.find(line)
    while at >= 0:
        end = body.find("\n", at)
        end = len(body) if end < 0 else end
        rest = body[at + len(line) : end].strip()
        if (at == 0 or body[at - 1] == "\n") and rest in ("", "--"):
            if entities is None:
                entities = []
            else:
                entities.append(body[begun : max(begun, at - 1 - (body[at - 2 : at] == "\r\n"))])
            if rest:
                return entities
            begun = end + 1
        at = body.find(line, end)
    if entities is not None:
        entities.append(body[begun:])
    return entities


def _shown(headers: dict[str, str], body: str, depth: int) -> list[str]:
    kind = headers.get("content-type", "text/plain")
    main = kind.partition(";")[0].strip().lower()
    params = _params(kind) if ";" in kind else {}
    if main.startswith("multipart/") and depth < 20:
        entities = _multipart(body, params["boundary"]) if params.get("boundary") else None
        if entities is not None:
            return [part for e in entities for part in _shown(*_split(e), depth + 1)]
        main = "text/plain"  # a damaged mail is shown as it stands
    if main == "message/rfc822" and depth < 20:
        return _shown(*_split(body), depth + 1)
    if "/" in main and not main.startswith("text/"):
        return []
    text = _decoded(body, headers.get("content-transfer-encoding", "").strip().lower(), params.get("charset", ""))
    return [html_text(text) if main == "text/html" else text]


def shown_parts(mail: str) -> list[str]:
    """The plain and HTML bodies and the text attachments of a mail, decoded, without headers.

    A text that does not begin with a header is a body without headers. Damaged parts give
    what can be decoded; unknown character sets are read as UTF-8. An empty text has one
    empty part.
    """
    if not _HEADER_LINE.match(mail):
        return [mail]
    if mail.startswith("From "):
        mail = mail.partition("\n")[2]
    return _shown(*_split(mail), 0)
