import email
import random
from email.mime.application import MIMEApplication
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest

from trendloom.llm.leaks import context_kinds, leaked_items, reparameterised_items, words
from trendloom.llm.mailparts import html_text, shown_parts


def test_words():
    assert words("The “Quick”, bro­wn_fox; Кит КИТ ｆｏｘ résumé résumé STRASSE straße 12²") == ["the", "quick", "brown", "fox", *[words("кит")[0]] * 2, "fox", "résumé", "résumé", "strasse", "strasse", "12²"]
    assert words("") == [] and words("​ .") == []


def test_html_text():
    got = html_text("<html><head><title>no</title><style>p{}</style></head><body><!-- no --><p>One&nbsp;<b>t</b>wo<br>three</p><div>four</div><span style='display:none'>no</span>&eacute;&lt;<script>no()</script></body></html>")
    assert got.split() == ["One", "two", "three", "four", "é<"]
    assert html_text("a < b &amp c") == "a < b & c"


def mail(seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["Grüße ", "word ", "=3D ", "\n", "> quoted\n", "漢字 ", "line that is rather long and goes on "]) for _ in range(30))
    m = MIMEMultipart("mixed")
    alt = MIMEMultipart("alternative")
    for kind, body in (("plain", text()), ("html", f"<p>{text()}</p>")):
        p = MIMEText(body, kind, "utf-8")
        if rng.random() < 0.5:
            del p["Content-Transfer-Encoding"]
            p["Content-Transfer-Encoding"] = "quoted-printable"
            import quopri

            p.set_payload(quopri.encodestring(body.encode()).decode())
        alt.attach(p)
    m.attach(alt)
    m.attach(MIMEText("id;count\n1;2", "csv", "utf-8"))
    m.attach(MIMEApplication(b"binary"))
    m["Subject"] = "s"
    out = m.as_string()
    return out.replace("\n", "\r\n") if rng.random() < 0.3 else out


@pytest.mark.parametrize("seed", range(20))
def test_parts_as_the_standard_library_sees_them(seed):
    text = mail(seed)
    expected = []
    for p in email.message_from_bytes(text.encode()).walk():
        if p.get_content_maintype() == "text":
            body = p.get_payload(decode=True).decode("utf-8", "replace")
            expected.append(words(html_text(body) if p.get_content_subtype() == "html" else body))
    assert [words(p) for p in shown_parts(text)] == expected


def test_damaged_mails():
    assert shown_parts("") == [""] and shown_parts("no header here\n\nbody") == ["no header here\n\nbody"]
    assert shown_parts("Subject: x") == [""]
    assert words(shown_parts("Content-Type: multipart/mixed; boundary=b\n\n--b\n\nfirst\n--b\nContent-Type: text/html\n\n<p>sec")[1]) == ["sec"]
    assert words(shown_parts("Content-Type: multipart/mixed\n\nplain")[0]) == ["plain"]
    assert words(shown_parts("Content-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQ=\n!!")[0]) == ["hello", "world"]
    assert shown_parts("Content-Transfer-Encoding: base64\n\naGVsbG8gd29yb") == ["hello wor"]
    assert shown_parts("Content-Type: text/plain; charset=no-such\nContent-Transfer-Encoding: quoted-printable\n\n=C3=A9") == ["é"]


def brute(docs, items, width=13):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - width + 1):
            grams.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = set()
    for d, t in docs:
        for p in shown_parts(t) if t is not None else []:
            w = words(p)
            for k in range(len(w) - width + 1):
                out.update((d, i) for i in grams.get(tuple(w[k : k + width]), ()))
    return sorted(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    nouns = ["anchor", "basket", "candle", "dagger", "engine", "falcon", "garden", "hammer"]
    make = lambda: f"Suppose {rng.choice(['two', 'seven', '40'])} {rng.choice(['yards', 'pints'])} of {rng.choice(nouns)} reach the {rng.choice(nouns)} while one {rng.choice(nouns)} crosses the {rng.choice(nouns)} twice a day and {rng.choice(nouns)} sleeps."
    items = [(i, " ".join(make() for _ in range(rng.randint(1, 3)))) for i in range(12)] + [(90, None), (91, ""), (92, "short one"), (3, make())]
    docs = []
    for d in range(120):
        w = items[rng.randrange(12)][1].split()
        n = rng.choice([8, 12, 13, 14, len(w)])
        k = rng.randint(0, max(0, len(w) - n))
        piece = " ".join(w[k : k + n])
        change = rng.random()
        if change < 0.2:
            piece = piece.upper().replace(" ", "\n> ")
        elif change < 0.4:
            piece = piece.replace("e", "е").replace("twice", "tw​ice")
        elif change < 0.6:
            piece = piece.replace("yards", "pints").replace("two", "seven")
        docs.append((d, f"Subject: x\n\nHello there, {piece} and so on."))
    docs += [(500, None), (501, ""), (502, "Subject: " + items[0][1]), (503, "x " * 50_000 + items[0][1]), (503, "y")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS template", "2 AS slots")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS template")
    expected = brute(docs, items)
    assert len(expected) > 30
    assert sorted(tuple(r) for r in leaked_items(d, i).collect()) == expected
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_other_parameters(spark):
    item = "Suppose seven yards of lunar ember reach the mill while one anchor trades the amber candle twice a day and every three yards of drum wait at seven o'clock. We have five yards. Nine yards remain."
    other = item.replace("seven", "eleven").replace("yards", "barrels")
    mixed = item.replace("Suppose seven", "Suppose eleven")
    noise = "barrels: four barrels, six barrels, two barrels, nine barrels."
    docs = spark.createDataFrame([(1, item), (2, other), (3, mixed), (4, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, noise)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_changed"], r["n_same"]) for r in reparameterised_items(docs, items).collect()}
    assert (1, 7) not in got and (4, 7) not in got
    assert got[2, 7][0] > got[2, 7][1] > 0  # windows without slots stay as they are
    assert got[3, 7] == (2, 23)  # two windows hold the second word


def test_parameters_that_no_item_holds(spark):
    item = "Today the keeper Alice carried seven pints of lunar ember past the mill while her friend Bob counted seven pints of drum oil and slept."
    changed = item.replace("Alice", "Zuleika").replace("Bob", "Yorick").replace("pints", "litres").replace("seven", "forty")
    odd = item.replace("pints", "firkins")
    wrapped = changed.replace("while her ", "while\n> her ")
    loose = changed.replace("mill", "barn")
    docs = [(1, item), (2, changed), (3, odd), (4, wrapped), (5, item.replace("mill", "barn").replace("carried", "held")), (6, loose)]
    d = spark.createDataFrame([(i, f"Subject: x\n\nHello. {t}") for i, t in docs], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_changed"], r["n_same"]) for r in reparameterised_items(d, i).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2] == got[4] == (13, 0)


def test_context_has_the_words_of_a_text():
    for text in ("The “Quick”, bro­wn_fox; Кит КИТ ｆｏｘ résumé STRASSE straße 12²", "ǰx ŉa İstanbul aͅb", "", " . ", "No. Go _on"):
        assert context_kinds(text)[0] == words(text.replace("ͅ", "ι"))
