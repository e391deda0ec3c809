import random

from gaugemill.llm import pii

from . import brute

KIND = {k: i for i, k in enumerate(pii.KINDS)}


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(5)
    alphabet = "a.@-+ 1239()%_4é\n"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(20000)]
    texts += ["1.2.3.4.5.6.7.8", "0001.2.3.4", "a@b.c@d.e", "4111 1111 1111 1111", "x@y..z@q.r", "9" * 4000 + ".1.2.3", "+1 (743) 555-3824"]
    for text in texts:
        assert pii.base_spans(text) == [(KIND[k], a, b) for k, a, b in brute.private(text)], text


def test_contexts_teach_unseen_identifiers(spark):
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "4222222222222"]
    rows = [(i, f"noise{i} my card number {c} was lost{i}", "x") for i, c in enumerate(good)]
    rows += [(20, "noise my card number 1234567812345678 was lost", "y"), (21, "order code 1234567812345670000 here", "z"), (22, None, None), (None, "", None), (23, "a" * 200_000 + " x@y.zz", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in pii.extract(docs, ["doc_id"]).collect()}
    assert [(m.kind, m.start, m.end) for m in found[20].learnt] == [(2, 21, 37)] and not found[21].learnt and found[0].n_card == 1
    assert found[22].base_sha256 == found[None].base_sha256 == brute.hashlib.sha256(b"").hexdigest() and found[23].n_email == 1
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[20].text == "noise my card number <CARD> was lost" and clean[22].text is None and clean[21].text == rows[7][1] and clean[0].spans == "x"
    assert pii.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_stay_and_keep_their_own_spans(spark):
    rows = [(1, "to a@b.cc"), (1, "to a@b.cc"), (1, "+12 345 678 90")]
    found = pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    text = pii.spans_text(pii.F.concat("base", "learnt")).alias("s")
    assert sorted(r.s for r in found.select(text).collect()) == ["email:3:9", "email:3:9", "phone:0:14"]


def test_contexts_teach_every_kind_whatever_its_form(spark):
    rows = [(i, f"n{i} call me at +1 555 010 {1000 + i} now{i}") for i in range(30)]
    rows += [(100 + i, f"n{i} please mail to user{i}@site{i}.example today{i}") for i in range(30)]
    rows += [(200 + i, f"n{i} my card is {c} ok") for i, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "4222222222222"])]
    rows += [(40, "n call me at 5551234567 please"), (41, "n call me at 0044 20 7946 0958 please"), (42, "n please mail to user@localhost, thanks"), (43, "n my card is 123456789012345 ok"), (44, "order 5551234567 of x@y and 0044 20 7946 0958")]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [clean[i] for i in (40, 41)] == ["n call me at <PHONE> please"] * 2
    assert clean[42] == "n please mail to <EMAIL>, thanks" and clean[43] == "n my card is <CARD> ok"
    assert {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows[-1:], "doc_id long, text string")).collect()} == dict(rows[-1:])


def test_a_very_long_text_without_spaces_takes_time_in_proportion():
    import time

    def took(n):
        text = "a@b.cc," * n
        began = time.process_time()
        found = pii.base_spans(text)
        assert len(found) == n and all(len(pii._contexts(text, a, b)) <= 2 for _, a, b in found)
        return time.process_time() - began

    assert took(200_000) < 40 * took(20_000)


def test_words_around_a_span():
    text = "one two a@b.cc,  three" + " " * 5000 + "c@d.ee"
    assert pii._contexts(text, 8, 14) == ["one two _"] and pii._word_after(text, 14) == ","
    assert pii._contexts(text, len(text) - 6, len(text)) == ["a@b.cc three _"]
