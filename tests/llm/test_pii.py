import re

import pytest

from framesift.llm import pii
from framesift.llm.common import keyed

SCHEMA = "doc_id long, text string, kinds string"

TEXTS = {
    1: "Mail und.34@mail7.example.com, again UND.34@MAIL7.EXAMPLE.COM. End",
    2: "ip 152.143.123.131### and 1.2.3.4. not 1.2.3 nor 999.1.1.1.1",
    3: "card 4785380592391139$$$ or 4785-3805-9239-1139, valid 4111 1111 1111 1111",
    4: '+1 (017) 555-7713 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
    5: "Mrs. Maria Lopez met Mr Ivan. Госпожа Анна Петрова; Herr Müller",
    6: "DE44500105175407324931 078-05-1120 a@b.co b@b.co c@b.co",
    7: "again: 152.143.123.131, und.34@mail7.example.com and Mrs Maria Lopez",
    8: "clean words, 12 numbers 3.14 and 2024-01-02; $5 $1 \\1",
    9: "",
    10: None,
    11: "x" * 50_000 + "@" * 1000 + "." * 1000 + "1." * 20_000 + " " + "a.b" * 20_000 + " und.34@mail7.example.com",
}
REPLACED = {1: 2, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5, 7: 3, 8: 0, 9: 0, 10: 0, 11: 1}


@pytest.fixture(scope="module")
def told(spark):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS.items()], SCHEMA)
    return {r.doc_id: r for r in pii.replace_personal_data(frame, "secret").collect()}


def test_counts_and_clean_texts(told):
    assert {i: r.n_replaced for i, r in told.items()} == REPLACED
    for i in (8, 9, 10):
        assert told[i].text == TEXTS[i] and told[i].kinds == ""
    assert told[5].kinds == "person" and told[6].kinds == "email,iban,national"


def test_formats(told):
    a, b = re.fullmatch(r"Mail ([a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com), again (.*)\. End", told[1].text).groups()
    assert b == a.upper() and a != "und.34@mail7.example.com"
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}### and (\d{1,3}\.){3}\d{1,3}\. not 1\.2\.3 nor 999\.1\.1\.1\.1", told[2].text)
    one, same, valid = re.fullmatch(r"card (4\d{15})\$\$\$ or (4\d{3}(?:-\d{4}){3}), valid (4\d{3}(?: \d{4}){3})", told[3].text).groups()
    assert same.replace("-", "") == one

    def luhn(number):
        digits = [int(c) for c in number if c.isdigit()][::-1]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10

    assert luhn(valid) == 0 and luhn(one) == luhn("4785380592391139")
    key, again = re.fullmatch(r'\+\d \(\d{3}\) \d{3}-\d{4} token = "([0-9a-f]{40})"### ([0-9a-f]{40})', told[4].text).groups()
    assert key == again != "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    woman, man, russian, german = re.fullmatch(
        r"Mrs\. (\w+ \w+) met Mr (\w+)\. Госпожа ([А-Яа-я]+ [А-Яа-я]+); Herr (\w+)", told[5].text
    ).groups()
    assert woman.split()[0].endswith("lia") and man.endswith("ron") and russian.split()[0].endswith("лия") and german.endswith("ron")
    first, *_ = told[7].text.split(",")
    assert first.removeprefix("again: ") == told[2].text.split("###")[0].removeprefix("ip ")
    assert a in told[7].text and woman in told[7].text
    addresses = re.findall(r"\S+@\S+", told[6].text)
    assert len(set(addresses)) == 3 and len({x.split("@")[1] for x in addresses}) == 1
    assert told[11].text.endswith(a) and told[11].text[:-len(a)] == TEXTS[11].removesuffix("und.34@mail7.example.com")


#: Texts with their personal data marked by hand: [[kind:entity]]. Nothing here is read off the code.
LABELLED = [
    "Frau Dr. [[person:Müller]] und Herr Prof. [[person:Weber]] mit Prof. Dr. [[person:Anna Weber]].",
    "Mr. [[person:O'Brien]] met Mr [[person:McDonald]], Mr. [[person:J. Smith]] and Mme [[person:de la Tour]] today.",
    "Dr [[person:Ludwig van Beethoven]] wrote; Mrs [[person:Anne-Marie Dupont]] read.",
    "pay [[iban:DE89 3704 0044 0532 0130 00]] or [[iban:GB29NWBK60161331926819]] now",
    "card [[card:4111 1111 1111 1111]] and [[card:5500005555555559]] please",
    "keys AKIA[[secret:IOSFODNN7EXAMPLE]] and ghp_[[secret:16C7e42F292c6912E7710c838347Ae178B4a]] leaked",
    "password: [[secret:hunter2]] but password: required, token = [[secret:abcdefghijkl]]",
    "hosts [[ip:10.0.0.1]] [[ipv6:2001:0db8:85a3:0000:0000:8a2e:0370:7334]] [[ipv6:fe80::1ff:fe23:4567:890a]] at 12:30:45",
    "call [[phone:+1 555-123-4567]] or [[phone:555-123-4567]], ssn [[national:078-05-1120]], mail [[email:a.b@c.org]]!",
    "The doctor said Dr who, std::vector, Mr MISTER, 2024-01-02, version 1.2.3 and ABCD.",
]


def test_labelled_texts(spark):
    """Every marked entity is replaced, and nothing else in the texts changes."""
    mark = re.compile(r"\[\[(\w+):(.*?)\]\](?!\])")
    plain = [mark.sub(r"\2", t) for t in LABELLED]
    frame = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_personal_data(frame, "k").collect()}
    for i, marked in enumerate(LABELLED):
        entities = mark.findall(marked)
        shape = re.escape(mark.sub("\0", marked)).replace("\0", "(.+?)")
        made = re.fullmatch(shape.replace(re.escape("\0"), "(.+?)"), got[i].text)
        assert made, (marked, got[i].text)
        assert all(old != new for (_, old), new in zip(entities, made.groups())), got[i].text
        assert got[i].n_replaced == len(entities) and got[i].kinds == ",".join(sorted({k for k, _ in entities}))


def test_formats_are_valid(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FE80::1FF:FE23:4567:890A", "Mr. J. Smith", "Mme de la Tour"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.replace_personal_data(frame, "k").orderBy("doc_id").collect()]
    for old, new in zip(texts[:2], got):
        assert [c == " " for c in old] == [c == " " for c in new] and old[:2] == new[:2]
        plain = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"[0-9A-F]{4}::[0-9A-F]{3}:[0-9A-F]{4}:[0-9A-F]{4}:[0-9A-F]{4}", got[2])
    assert re.fullmatch(r"Mr\. [A-Z]\. [A-Z][a-z]+", got[3]) and re.fullmatch(r"Mme de la [A-Z][a-z]+", got[4])


def test_coreference(spark):
    texts = ["Dr Anna Schmidt", "Frau Anna Schmidt", "Herr Schmidt", "Frau Schmidt", "Dr Schmidt", "+1 555-123-4567", "555-123-4567", "Prof. Dr. Anna Schmidt"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.replace_personal_data(frame, "k").orderBy("doc_id").collect()]
    names = [re.sub(r"^(?:Dr|Frau|Herr|Prof)\.? (?:Dr\. )?", "", t) for t in got]
    assert names[0] == names[1] == names[7] and names[0].split()[0].endswith("lia")
    assert len({names[2], names[3], names[4]}) == 3
    assert got[5] == f"+1 {got[6]}" and got[6] != texts[6]


def test_long_entities_are_replaced_whole(spark):
    secret, name = "aB3_" * 75, "Anna Maria Luisa Elena Petrova"
    keys = ["0f" * 64, "9E" * 300, "a" * 70 + "1" * 70]
    texts = [f"api_key={secret} end", *(f"key {k}." for k in keys), f"Mrs {name} came", "Mr " + "Xa" + "b" * 60 + " Petrov came"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_personal_data(frame, "k").collect()}
    assert [got[i].n_replaced for i in range(6)] == [1] * 6
    assert re.fullmatch(r"api_key=(?:[a-z][A-Z]\d_){75} end", got[0].text) and secret not in got[0].text
    for i, k in enumerate(keys, 1):
        made = re.fullmatch(r"key (\w+)\.", got[i].text)[1]
        assert len(made) == len(k) and made != k and made.isupper() == k.isupper()
        assert re.fullmatch("[0-9a-f]+|[0-9A-F]+", made) and not any(k[j : j + 32] in made for j in range(0, len(k) - 32, 32))
    woman = re.fullmatch(r"Mrs (\w+(?: \w+){4}) came", got[4].text)[1]
    assert not set(name.split()) & set(woman.split())
    assert re.fullmatch(r"Mr \w+ \w+ came", got[5].text) and "Petrov" not in got[5].text


def test_long_runs_take_linear_time(spark):
    runs = ["api_key=" + "a" * 40_000 + "!", "1f" * 40_000 + "g", "Mr" + " Ab" * 10_000 + "C", "ab" * 40_000, "Mr A" + "b" * 40_000]
    frame = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    assert [r.n_replaced for r in pii.replace_personal_data(frame, "k").orderBy("doc_id").collect()] == [1, 0, 1, 0, 1]


def test_distinct_surrogates_in_a_small_space(spark):
    """All 26 one-letter names at a host: there are just as many surrogates of that shape, so attempts collide."""
    entities = [("email", f"{c}@b.co") for c in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"1.1.1.{i}") for i in range(200)]
    made = pii.surrogates(spark.createDataFrame(entities, "kind string, canonical string"), "k").collect()
    originals = {c for _, c in entities}
    assert len(made) == len(entities) and len({r.surrogate for r in made}) == len(entities)
    assert not originals & {r.surrogate for r in made}


def test_key_settles_surrogates(spark):
    frame = spark.createDataFrame([(1, "x a.b@mail.org y", None)], SCHEMA)
    texts = [pii.replace_personal_data(frame, key).first().text for key in ("k", "k", "other")]
    assert texts[0] == texts[1] != texts[2]


def test_odd_ids_and_empty_table(spark):
    rows = [(None, "1.2.3.4 a", None), (None, None, None), (5, "1.2.3.4 b", None), (5, "c", None)]
    got = pii.replace_personal_data(spark.createDataFrame(rows, SCHEMA), "k")
    assert got.columns == ["doc_id", "text", "n_replaced", "kinds"]
    seen = got.collect()
    assert sorted((str(r.doc_id), r.n_replaced) for r in seen) == [("5", 0), ("5", 1), ("None", 0), ("None", 1)]
    assert len({r.text[:-2] for r in seen if r.n_replaced}) == 1
    assert pii.replace_personal_data(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_whole_table(spark, sf):
    from framesift.llm.queries import op10_pii_surrogates

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in op10_pii_surrogates(spark, sf).collect()}
    assert set(before) == set(after)
    found = {}
    for r in pii.mentions(keyed(docs, "doc_id", _text="text")).collect():
        found.setdefault(r["__row"], []).append(r)
    assert len(found) > 5
    mapped = {}
    for i, text in before.items():
        listed = sorted(found.get(i, []), key=lambda r: r.place)
        assert after[i].n_replaced == len(listed)
        assert after[i].text != text if listed else after[i].text == text
        for r in listed:  # what stands between entities is as it was
            between, text = text.split(r.value, 1)
            assert between in after[i].text and r.body not in after[i].text
            mapped.setdefault((r.kind, r.canonical), set()).add(i)
    assert any(len(ids) > 1 for ids in mapped.values())


def test_plan_has_no_python(spark, sf):
    from framesift.llm.queries import op10_pii_surrogates

    plan = op10_pii_surrogates(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
