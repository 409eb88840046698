import re

from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import pii

KEY = b"test key"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400))
def test_feistel_permutes_every_size(size):
    f = pii.Feistel(KEY)
    moved = [f.permute(x, size, "t") for x in range(size)]
    assert sorted(moved) == list(range(size))
    assert [f.restore(x, size, "t") for x in moved] == list(range(size))


def card(body):
    return body + pii.check_digit(body)


TEXT = (
    "Pay " + card("411111111111111") + " or 4111-1111-1111-1111, not 4111111111111112. Call +1 (415) 555-0132 or +49 30 1234 5678. "
    "Born 1987-02-28, seen 31.12.2001 and 02/30/2001 and 12/31/2001; id 219-09-9999, no 000-12-3456. "
    "Host 10.0.255.1, not 300.1.1.1 nor 1.2.3.4.5; mail Jo.Doe42@mail.example.com. v1.2.3 x1234567890123456y 3.14159265358979"
)


def test_values_keep_their_format_and_come_back():
    p = pii.Pseudonyms(KEY)
    out, found = p.apply(TEXT)
    kinds = [f["kind"] for f in found]
    assert kinds == ["card", "card", "phone", "phone", "date", "date", "date", "ssn", "ip", "email"]
    assert out != TEXT and re.sub(r"\d", "9", out).split("Host")[0] == re.sub(r"\d", "9", TEXT).split("Host")[0]
    for f in found:
        assert TEXT[f["start"] : f["end"]] != f["pseudonym"]
        again, kinds = pii.Pseudonyms(KEY).apply(f["pseudonym"])
        assert [k["kind"] for k in kinds] == [f["kind"]]
    assert pii.luhn(re.sub(r"\D", "", found[0]["pseudonym"]))
    # the same number under other separators is the same person
    assert re.sub(r"\D", "", found[0]["pseudonym"]) == re.sub(r"\D", "", found[1]["pseudonym"])
    assert pii.Pseudonyms(KEY, back=True).apply(out)[0] == TEXT
    assert pii.Pseudonyms(b"other").apply(TEXT)[0] != out


def test_rows(spark):
    rows = [(1, TEXT, "x", 0), (2, None, "x", 0), (3, "", "x", None), (None, TEXT, None, 1), (1, TEXT, "x", 0), (4, "a " * 60_000 + "10.1.2.3", "l", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings string, n_found int")
    got = pii.pseudonymise(df, KEY)
    out = {(r.doc_id, r.n_found, r.text) for r in got.collect()}
    moved = pii.Pseudonyms(KEY).apply
    assert out == {(i, len(moved(t or "")[1]), None if t is None else moved(t)[0]) for i, t, *_ in rows}
    assert sorted(map(str, pii.pseudonymise(got.select("doc_id", "text"), KEY, back=True).select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
    assert pii.pseudonymise(df.limit(0), KEY).collect() == []


def digits(text):
    return re.sub(r"\D", "", text)


def test_numbers_beside_others_are_found():
    apply, back = pii.Pseudonyms(KEY).apply, pii.Pseudonyms(KEY, back=True).apply
    number = digits(apply("4111111111111111")[0])
    for n in range(100):
        for form in ("4111111111111111 {}", "4111111111111111 {}/27", "{} 4111111111111111", "qty {} 4111-1111-1111-1111", "4111 1111 1111 1111 1{}", "4111111111111111-{}"):
            text = form.format(f"{n:02}")
            out, found = apply(text)
            assert [(f["kind"], digits(f["pseudonym"])) for f in found] == [("card", number)], text
            assert back(out)[0] == text
    text = "12 2024-05-01 12345 and 1234 4111 1111 1111 1111"
    out, found = apply(text)
    assert "4111 1111 1111 1111" not in out and "date" in [f["kind"] for f in found] and back(out)[0] == text
    for n in range(2000):
        text = f"{n:04} {n % 7}4111 {n * 37 % 10000:04} 1111 1111 {n * 13 % 997}"
        assert back(apply(text)[0])[0] == text


def test_phone_numbers_are_linked():
    apply, back = pii.Pseudonyms(KEY).apply, pii.Pseudonyms(KEY, back=True).apply
    one = lambda t: [digits(f["pseudonym"]) for f in apply(t)[1]]
    want = one("+1 (415) 555-0132")
    assert len(want) == 1
    for text in ("+1 (415) 555-0132 42", "+1 (415) 555-0132 2024", "+14155550132", "+1 415.555.0132, 7"):
        assert one(text) == want and back(apply(text)[0])[0] == text
    assert one("+49 30 1234 5678") == one("+493012345678") != []
    text = "+1 (415) 555-0132 4111 1111 1111 1111"
    assert [f["kind"] for f in apply(text)[1]] == ["phone", "card"] and back(apply(text)[0])[0] == text


def test_digits_of_other_scripts_stay_as_they_are():
    for text in ("١٢٣-٤٥-٦٧٨٩", "+٤٩ ٣٠ ١٢٣٤٥٦٧", "１９８７-０２-２８", "١٠.٠.٠.١ and ४१११११११११११११११"):
        out, found = pii.Pseudonyms(KEY).apply(text)
        assert out == text and found == []
    mixed = "+٤٩ ٣٠ ١٢٣٤٥٦٧ or +49 30 1234567"
    out, found = pii.Pseudonyms(KEY).apply(mixed)
    assert [f["kind"] for f in found] == ["phone"] and out.startswith("+٤٩ ٣٠ ١٢٣٤٥٦٧ or +49 ")
    assert pii.Pseudonyms(KEY, back=True).apply(out)[0] == mixed


def test_all_valid_dates_of_a_format_are_permuted():
    """Every day of two centuries once: pseudonyms are days of the same format, each met once, and all found by a plain matcher."""
    import datetime

    days = [datetime.date.fromordinal(n).isoformat() for n in range(pii.FIRST_DAY, pii.LAST_DAY + 1)]
    p, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    moved = [p.apply(d)[0] for d in days[:4000]]
    assert len(set(moved)) == len(moved) and set(moved) <= set(days) and moved != days[:4000]
    assert [back.apply(d)[0] for d in moved] == days[:4000]


def test_finds_what_an_independent_matcher_finds():
    """Words alone between blanks: validity by plain rules."""
    import calendar
    import random

    rnd = random.Random(6)

    def plain(word):
        parts = word.split("-")
        if len(parts) == 3 and all(x.isascii() and x.isdigit() for x in parts):
            if [len(x) for x in parts] == [4, 2, 2]:
                year, a, b = map(int, parts)  # the month may come first or last
                return 1900 <= year <= 2099 and any(1 <= m <= 12 and 1 <= d <= calendar.monthrange(year, m)[1] for m, d in ((a, b), (b, a)))
            if [len(x) for x in parts] == [3, 2, 4]:
                a, b, c = map(int, parts)
                return not (a in (0, 666) or a >= 900 or b == 0 or c == 0)
        if word.isascii() and word.isdigit() and 13 <= len(word) <= 19:
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(word)))
            return total % 10 == 0
        return False

    number = lambda k: "".join(rnd.choices("0123456789", k=k))
    make = [
        lambda: f"{rnd.choice(['1987', '2099', '1899', number(4)])}-{number(2)}-{number(2)}", lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f"{rnd.choice(['000', '666', '912'])}-{number(2)}-{number(4)}", lambda: number(rnd.randint(12, 20)), lambda: card(number(15)), lambda: "word",
    ]
    words = [rnd.choice(make)() for _ in range(3000)]
    for w in words:
        assert bool(pii.Pseudonyms(KEY).apply(f"see {w}, then")[1]) == plain(w), w
