import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.pii import find, find_all, find_pii, joined, mask, mask_text

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+%1 024(x\n5é@.", max_size=50))
def test_plain_spans(text):
    assert find(text) == brute(text)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = find_pii(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(re.findall(f"{k}:", r["spans"])) for k in base]
    assert sum(r["n_email"] for r in got) > 0 and sum(r["n_card"] for r in got) > 0


def only(text, kind, source):
    base, every = find_all(text)
    assert [text[a:b] for a, b in every[kind] if (a, b) not in base[kind]] == [source], (text, every)


def test_disguises_map_back_to_their_source():
    only("write to jane.doe [at] mail (dot) example [dot] org now", "email", "jane.doe [at] mail (dot) example [dot] org")
    only("jane at example dot com, please", "email", "jane at example dot com")
    only("mail jаne@exаmple.com", "email", "jаne@exаmple.com")  # Cyrillic a
    only("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")
    only("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com")
    only("host 10 dot 0 dot 12 dot 255 is up", "ip", "10 dot 0 dot 12 dot 255")
    only("call plus one five five five two three four six seven eight nine today", "phone", "plus one five five five two three four six seven eight nine")
    only("card four one one one 1111 1111 one one one one ok", "card", "four one one one 1111 1111 one one one one")
    only("٤١١١ 1111 1111 1111", "card", "٤١١١ 1111 1111 1111")


def test_few_disguised_characters():
    only("call plus 44 20 7946 0958", "phone", "plus 44 20 7946 0958")
    only("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one")
    only("host 10.two.3.4", "ip", "10.two.3.4")
    assert mask_text("call plus 44 20 7946 0958.") == "call [phone]."


def test_spoken_at_before_plain_and_disguised_dots():
    only("jane at mail.example dot com", "email", "jane at mail.example dot com")
    only("jane at a.b.example (dot) co.uk, please", "email", "jane at a.b.example (dot) co.uk")
    for text in ("look at example.com", "look at www.example.com or dot com", "jane at mail.example. dot com"):
        assert find_all(text)[1]["email"] == [], text
    for c in (" at a.a", " at a. dot ", "a at a.", ".a", " at a dot"):
        find_all(c * 50_000)
    find_all("a at " + "a." * 100_000)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from([*" -.+@:\n", "plus ", "one", "Two ", "five ", "0", "10.", "7946", "4111 1111 1111 ", "111", " at ", "(at)", "[dot]", " DOT ", "jane", "mail.example", "é"]), max_size=14))
def test_spans_do_not_depend_on_other_words(parts):
    text = "".join(parts)
    assert find_all(text) == find_all(text + "\n.\nanecdote")


def test_plain_text_gains_nothing():
    for text in ("look at example.com", "we met at noon. dot com boom", "one two three", "plus one", "at that point (at home) [dot]", "naïve café – ok", "Элемент в тексте", "four score and seven"):
        base, every = find_all(text)
        assert base == every == {k: [] for k in base}, text


def test_long_runs_take_linear_time():
    for c in ("1", "a", "1.", "+1", "@", "a@", "one ", "1 ", "-", "("):
        find_all(c * 200_000)


def test_edges_and_mask(spark):
    rows = [(1, None, 3, "x"), (1, "", 3, "x"), (1, "", 3, "x"), (None, "a@b.co or +1 (555) 555-1234", 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = find_pii(df).collect()
    assert sorted(r["spans"] for r in out) == ["", "", "", "email:0:6,phone:10:27"]
    assert [r["base_sha256"] for r in out if not r["spans"]] == [hashlib.sha256(b"").hexdigest()] * 3
    assert sorted(map(tuple, mask(df).collect()), key=str) == sorted([(1, None, None, "x"), (1, "", 0, "x"), (1, "", 0, "x"), (None, "[email] or [phone]", 18, "x")], key=str)
    assert find_pii(df.limit(0)).collect() == [] and mask(df).columns == df.columns
    assert mask_text("no data") == "no data"


def test_a_disguise_beyond_a_plain_part_is_masked_whole():
    text = "write john dot smith@example.com or plain@example.org"
    base, every = find_all(text)
    assert [text[a:b] for a, b in every["email"]] == ["smith@example.com", "plain@example.org"] and every == base
    assert mask_text(text) == "write [email] or [email]"
    assert mask_text("jane@mail.example dot com!") == "[email]!"


def test_single_spelled_digits_and_plus_signs():
    only("call plus 1 555 234 6789 now", "phone", "plus 1 555 234 6789")
    only("call plus 15552346789", "phone", "plus 15552346789")
    only("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one")
    only("host 10.two.3.4", "ip", "10.two.3.4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["plus ", "one", "two ", "4", "11", ".", " ", "-", "@", "a", "at ", " dot ", "[at]", "x.com", "é", "\n"]), max_size=24), st.sampled_from(["", "anecdote ", " nothing else"]))
def test_found_spans_do_not_depend_on_other_words(parts, other):
    text = "".join(parts)
    got, more = find_all(text)[1], find_all(text + "\n" + other)[1]
    assert got == {k: [s for s in v if s[1] <= len(text)] for k, v in more.items()}
