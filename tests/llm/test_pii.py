"""Plain spans against the patterns as stated; disguises; masking."""

import random
import re

from plumbline.llm import pii


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_plain_spans():
    r = random.Random(2)
    for _ in range(30_000):
        t = "".join(r.choice("ab1.2@- +3()%4567890.0.") for _ in range(r.randint(0, 34)))
        assert sorted(pii.base_spans(t)) == brute(t), t
    assert pii.base_spans("1" * 50_000 + "." + "2" * 50_000) == []


def found(t):
    return [(pii.KINDS[k], t[a:b]) for k, a, b in pii.all_spans(t)[1]]


def test_disguises():
    assert found("mail john.doe [at] example [dot] com now") == [("email", "john.doe [at] example [dot] com")]
    assert found("john at mail dot example dot com is") == [("email", "john at mail dot example dot com")]
    assert found("call plus four nine one seven six one two three four five") == [("phone", "plus four nine one seven six one two three four five")]
    assert found("１９２.１６８.１.１ x") == [("ip", "１９２.１６８.１.１")]
    assert ("email", "jоhn@x.com") in found("jоhn@x.com")
    assert found("look at the dot matrix, one two three") == []
    assert found("") == []


def test_disguises_by_themselves():
    assert found("write jane at example.com today") == [("email", "jane at example.com")]
    assert found("write jane @ example.com today") == [("email", "jane @ example.com")]
    assert found("write jane at example [dot] com today") == [("email", "jane at example [dot] com")]
    assert found("call +49 one 5 two 3 four 6 7 eight 9 now") == [("phone", "+49 one 5 two 3 four 6 7 eight 9")]
    assert found("call +49 151 two 345 67 8 now") == [("phone", "+49 151 two 345 67 8")]
    assert found("host 192 dot 168 dot 0 dot 1 is up") == [("ip", "192 dot 168 dot 0 dot 1")]
    assert found("mail jane at example dot museum or") == [("email", "jane at example dot museum")]
    assert found("mail jane @ mail dot co dot example or") == [("email", "jane @ mail dot co dot example")]
    assert found("mail jane at mail dot example.museum or") == [("email", "jane at mail dot example.museum")]
    assert found("meet at noon. One dot, two dots; 3 dot 4") == []
    assert found("call plus four nine fİve one ſix one two three four") == [("phone", "plus four nine fİve one ſix one two three four")]


def test_columns_and_masking(spark):
    rows = [(1, "a@b.co and +49 (0) 151-2345 6789", 40, "s"), (None, None, None, None), (2, "", 0, "s"), (2, "", 0, "s"), (3, "x (at) y (dot) org", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    assert out[1].spans == "email:0:6,phone:11:32" and (out[1].n_email, out[1].n_phone, out[1].n_ip) == (1, 1, 0)
    assert out[None].base_sha256 == out[2].base_sha256 and out[3].n_email == 0 and out[3].spans == "email:0:18"
    masked = pii.mask(df)
    assert masked.columns == df.columns and masked.count() == 5
    got = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert got[1] == ("[EMAIL] and [PHONE]", 19) and got[None] == (None, None) and got[3] == ("[EMAIL]", 7)
    assert pii.find(df.where("false")).count() == 0


def test_long_runs_of_blanks_take_linear_time():
    import time

    for t in ("a [at]" + " " * 1_000_000 + "b dot c", "a at b" + " " * 1_000_000 + "dot com", " " * 1_000_000 + "(at) x", "a" + " dot" * 10_000, "[" + " " * 1_000_000):
        began = time.time()
        pii.all_spans(t)
        assert time.time() - began < 2, t[:10]
    assert found("x" + " " * 5000 + "[at] y.org") == [("email", "x" + " " * 5000 + "[at] y.org")]


def test_disguises_in_the_texts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    hidden = docs.selectExpr("doc_id", "concat(text, '\n write jane.roe (at) mail [dot] example dot org or plus four nine one five one two three four five six') as text")
    plain = {r.doc_id: r for r in pii.find(docs).collect()}
    got = {r.doc_id: r for r in pii.find(hidden).collect()}
    texts = {r.doc_id: r.text for r in hidden.collect()}
    for i, r in got.items():
        new = [x.split(":") for x in r.spans.split(",")]
        assert (r.n_email, r.n_phone) == (plain[i].n_email, plain[i].n_phone)
        shown = [(k, texts[i][int(a) : int(b)]) for k, a, b in new]
        assert ("email", "jane.roe (at) mail [dot] example dot org") in shown and any(k == "phone" and x.startswith("plus four nine") for k, x in shown)
