"""From a raw archived message to its readable text: MIME parts, transfer encodings, charsets, markup, quoting.

Pure functions of one text, used inside Arrow batches. They never raise: what cannot be decoded is
kept as it stands or, if it is no text at all, left out.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"[!-9;-~]+:")
_CTYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)(.*(?:\n[ \t].*)*)", re.I | re.M)
_CTE = re.compile(r"^content-transfer-encoding:[ \t]*([^;\s]+)", re.I | re.M)
_PARAM = re.compile(r"(charset|boundary)\s*=\s*(?:\"([^\"]*)\"|([^\s;\"]+))", re.I)
_HARD = re.compile(rb"=([0-9A-Fa-f]{2})")
_BREAK = re.compile(r"<\s*(?:br|/?p|/?div|/?li|/?tr|/?ul|/?ol|/?h[1-6]|/?blockquote|/?table|hr|/?body)\b[^<>]*>\n?", re.I)
_BLOCK = re.compile(r"<(/?)(script|style|head)\b[^<>]*>|(<!--)|(-->)", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_IS_HTML = re.compile(r"\s*<html\b", re.I)
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)

#: Parts nested deeper than this are read as they stand.
DEPTH = 100


def _payload(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        kept = re.sub(r"[^A-Za-z0-9+/]", "", body)
        kept = kept[: len(kept) - (len(kept) % 4 == 1)]
        raw = binascii.a2b_base64(kept + "=" * (-len(kept) % 4))
    elif encoding == "quoted-printable":
        # Line by line: white space at a line's end is none of the text, "=" there joins it with the next.
        lines = [x.rstrip(" \t") for x in body.split("\n")]
        soft = "".join(x[:-1] if x.endswith("=") else x + "\n" for x in lines)[: None if lines[-1].endswith("=") else -1]
        raw = _HARD.sub(lambda m: bytes((int(m[1], 16),)), soft.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            if charset not in ("utf-8", "utf8", "us-ascii", ""):
                return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
        # Cut inside a character, or another charset than the one declared.
        text = raw.decode("utf-8", "replace")
        return text if text.count("�") <= 1 + len(text) // 200 else raw.decode("cp1252", "replace")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte charset, line by line, where that gives valid UTF-8."""
    if not _MOJIBAKE.search(text):
        return text
    out = []
    for line in text.split("\n"):
        if _MOJIBAKE.search(line):
            for charset in ("cp1252", "latin-1"):
                try:
                    line = line.encode(charset).decode("utf-8")
                    break
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
        out.append(line)
    return "\n".join(out)


def _without_blocks(text: str) -> str:
    """Scripts, styles, heads and comments out, in one pass. One that is never closed stays."""
    out, at, opened, name = [], 0, 0, ""
    for m in _BLOCK.finditer(text):
        if not name:
            if m[3] or (m[2] and not m[1]):
                opened, name = m.start(), (m[2] or "-").lower()
        elif m[4] if name == "-" else m[1] and m[2].lower() == name:
            out.append(text[at:opened])
            at, name = m.end(), ""
    return " ".join([*out, text[at:]])


def strip_markup(text: str) -> str:
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _without_blocks(text)))).replace("\xa0", " ")


def split_headers(text: str) -> tuple[str, str]:
    """Header block and body. A text that does not begin with a header is all body."""
    if text.startswith("From ") and "\n" in text:
        text = text[text.index("\n") + 1 :]
    first = text.lstrip("\n")
    if not _HEADER.match(first):
        return "", text
    head, _, body = first.partition("\n\n")
    return head, body


def _leaves(head: str, body: str, depth: int, out: list[tuple[str, str]]) -> None:
    m = _CTYPE.search(head)
    kind, params = (m[1].lower(), {k.lower(): a or b for k, a, b in _PARAM.findall(m[2])}) if m else ("text/plain", {})
    if kind.startswith("multipart/") and params.get("boundary") and depth < DEPTH:
        sections = ("\n" + body).split("\n--" + params["boundary"])
        if len(sections) > 1:
            found: list[tuple[str, str]] = []
            for s in sections[1:]:
                if s.startswith("--"):
                    break
                s = s.partition("\n")[2] if not s.startswith("\n\n") else s[1:]
                if s.startswith("\n"):
                    h, b = "", s[1:]
                else:
                    h, _, b = s.partition("\n\n")
                _leaves(h, b, depth + 1, found)
            if kind == "multipart/alternative":  # one reading of the same content
                plain = [x for x in found if x[0] == "text/plain" and x[1].strip()]
                found = plain or found
            out += found
            return
    if kind.startswith("multipart/"):  # it cannot be taken apart: read as it stands
        kind = "text/plain"
    if not (kind.startswith("text/") or kind in ("", "message/rfc822")):
        return
    c = _CTE.search(head)
    text = repair(_payload(body, c[1].lower() if c else "", (params.get("charset") or "").lower()))
    if kind == "message/rfc822" and depth < DEPTH:
        _leaves(*split_headers(text), depth + 1, out)
        return
    if kind == "text/html" or _IS_HTML.match(text):
        text = strip_markup(text)
    out.append((kind, text))


def readable(text: str | None) -> list[str]:
    """Decoded text of each readable part, markup removed, quoting kept. Null and blank texts have none."""
    if not text or text.isspace():
        return []
    out: list[tuple[str, str]] = []
    _leaves(*split_headers(text.replace("\r\n", "\n").replace("\r", "\n")), 0, out)
    return [t.replace("\r\n", "\n").replace("\r", "\n") for _, t in out]


def unquote(text: str) -> str:
    """Drop the quote marks at the beginning of lines."""
    return _QUOTE.sub("", text)


_MARKS = re.compile(r"^[ \t]*((?:[>|][ \t]?)+)")
_RULE = re.compile(r"^\s*[_*=~#-]{5,}\s*$")
_ORIGINAL = re.compile(r"^\s*-{3,}\s*\S.{0,60}?-{3,}\s*$")
_FROM = re.compile(r"^\s*(?:from|von|de|expéditeur|remitente)\s?:", re.I)
#: How the usual mail programs introduce a quoted message.
_SAID = re.compile(r"^\s*(?:on|am|le|el)\b.{4,300}\b(?:wrote|schrieb|a écrit|écrit|escribió)\b.{0,120}:\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")


def prose(text: str | None) -> list[list[str]]:
    """Paragraphs of sentences that people wrote: own, quoted and attached text.

    Left out are headers, attributions, header blocks of quoted messages, signatures (from the
    line "-- " to the end of the quote level) and footers (from a rule of dashes or the like,
    unless a header block follows it).
    """
    out: list[list[str]] = []
    for part in readable(text):
        lines, depths = [], []
        for line in part.split("\n"):
            m = _MARKS.match(line)
            depths.append(m[1].count(">") + m[1].count("|") if m else 0)
            lines.append(line[m.end() :] if m else line)
        para: list[str] = []
        hidden: int | None = None  # quote level at which a signature or footer runs
        block = False  # inside the header block of a quoted message
        level = 0

        def close(para: list[str] = para) -> None:
            if para:
                found = [s for s in _SENTENCE.split(" ".join(para)) if s and not s.isspace()]
                if found:
                    out.append(found)
                para.clear()

        for i, (line, depth) in enumerate(zip(lines, depths, strict=True)):
            blank = not line or line.isspace()
            if depth != level:
                close()
                level, hidden = depth, None
            if block:
                block = not blank
                continue
            if blank:
                close()
                continue
            c = line.lstrip()[0]
            if c in "_*=~#-":
                if line.rstrip() == "--":
                    close()
                    hidden = depth
                    continue
                if _RULE.match(line):
                    close()
                    after = next((x for x in lines[i + 1 : i + 3] if x and not x.isspace()), "")
                    block = bool(_FROM.match(after))
                    hidden = None if block else depth
                    continue
                if _ORIGINAL.match(line):
                    close()
                    block, hidden = True, None
                    continue
            if c in "OoAaLlEe":
                whole = line if line.rstrip().endswith(":") else line + " " + lines[i + 1] if i + 1 < len(lines) and lines[i + 1].rstrip().endswith(":") and "<" in line + lines[i + 1] else ""
                if whole and _SAID.match(whole):
                    close()
                    hidden = None
                    if whole is not line:
                        lines[i + 1] = ""
                    continue
            if hidden is None:
                para.append(line.strip())
        close()
    return out
