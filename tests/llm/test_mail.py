from __future__ import annotations

import base64
import quopri
import time

import pytest

from tidemark.llm.mail import prose, readable, repair, strip_markup, unquote

HEAD = "From: a@b.example\nSubject: hi\nMIME-Version: 1.0\n"
BODY = "Grüße aus Köln.\nZweite Zeile = gut."


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize(
    ("encoding", "charset", "body"),
    [
        ("8bit", "utf-8", BODY),
        ("base64", "utf-8", base64.encodebytes(BODY.encode()).decode()),
        ("quoted-printable", "utf-8", quopri.encodestring(BODY.encode()).decode()),
        ("quoted-printable", "iso-8859-1", quopri.encodestring(BODY.encode("latin-1")).decode()),
        ("base64", "iso-8859-1", base64.b64encode(BODY.encode("latin-1")).decode()),
        ("base64", "no-such-charset", base64.b64encode(BODY.encode("latin-1")).decode()),
    ],
)
def test_encodings(encoding, charset, body, newline):
    text = f'{HEAD}Content-Type: text/plain; charset="{charset}"\nContent-Transfer-Encoding: {encoding}\n\n{body}'
    assert "".join(readable(text.replace("\n", newline))).strip() == BODY


def test_multipart_and_alternatives():
    inner = "--in\nContent-Type: text/plain\n\nplain\n--in\nContent-Type: text/html\n\n<b>plain</b>\n--in--\n"
    text = f'{HEAD}Content-Type: multipart/mixed;\n boundary="out"\n\npreamble\n--out\nContent-Type: multipart/alternative; boundary=in\n\n{inner}\n--out\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--out\nContent-Type: text/plain; name="a.txt"\n\nattached\n'
    assert [t.strip() for t in readable(text)] == ["plain", "attached"]


def test_markup():
    assert strip_markup("<html><head><title>t</title></head><body>a<br>\nb&amp;c <i>d</i><script>x<1</script><!-- no -->e</body>").split() == ["a", "b&c", "d", "e"]


def test_mojibake():
    assert repair("SchlÃ¶sser und Ã©tÃ©\nÄpfel") == "Schlösser und été\nÄpfel"


def test_no_message_at_all():
    assert readable(None) == readable("") == readable("  \r\n") == []
    assert readable("just words") == ["just words"]
    assert readable("From x Sat\nSubject: s\n\nbody") == ["body"]


def test_unquote():
    assert unquote("> > a\n| | b\n>c\n x > y") == "a\nb\nc\n x > y"


def test_prose_leaves_out_what_nobody_wrote():
    text = HEAD + "\nHello there. Second one?\n\nOn Mon, 1 Jan 2024, A B <a@b.example> wrote:\n> Quoted sentence that\n> goes on.\n> -- \n> A B\n> Coach\nMine again.\n\n-- \nMe\nGeneral Counsel\n____________\nlist footer\n\n-----Original Message-----\nFrom: X\nSent: then\n\nOld text.\n________________________________\nFrom: Y\nSubject: z\n\nOlder text."
    assert prose(text) == [["Hello there.", "Second one?"], ["Quoted sentence that goes on."], ["Mine again."], ["Old text."], ["Older text."]]


@pytest.mark.parametrize("junk", ["<script " * 60_000, "<!-- " * 60_000, " " * 500_000, "=" * 300_000, ">" * 300_000, "<br " * 60_000, "a." * 200_000, "_" * 300_000, "x\n" * 100_000])
def test_very_long_texts_take_linear_time(junk):
    for kind in ("text/plain", "text/html"):
        for encoding in ("8bit", "quoted-printable", "base64"):
            began = time.perf_counter()
            prose(f"{HEAD}Content-Type: {kind}\nContent-Transfer-Encoding: {encoding}\n\n{junk}")
            assert time.perf_counter() - began < 5
