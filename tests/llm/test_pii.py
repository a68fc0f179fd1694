import re

from cinelake.llm import pii
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF, crowded, documents, edge_rows

EMAIL, IP = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
TOKEN, CARD, PHONE = re.compile(r"\b[0-9a-fA-F]{40}\b"), re.compile(r"\b\d{16}\b"), re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, *texts):
    rows = pii.replace(documents(spark, list(enumerate(texts)))).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_query_replaces_every_planted_entity(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_pii_surrogates"](spark, SF).collect()
    assert len(got) == len(before)
    real, made = set(), {}
    for r in got:
        text = before[r["doc_id"]]
        for pattern in (EMAIL, IP, TOKEN, CARD, PHONE):
            old, new = pattern.findall(text), pattern.findall(r["text"])
            assert len(old) == len(new)
            real |= {x.lower() for x in old}
            for a, b in zip(old, new):
                made.setdefault(a.lower(), set()).add(b.lower())
        if r["n_entities"] == 0:
            assert r["text"] == text
    assert len(real) > 50 and all(len(v) == 1 for v in made.values())
    values = [v for s in made.values() for v in s]
    assert len(values) == len(set(values)) and not set(values) & real


def test_forms_and_kinds(spark):
    a, b, c = replaced(
        spark,
        "write to Jo.Doe7@mail.example.com or JO.DOE7@MAIL.EXAMPLE.COM, not ann@mail.example.com",
        "call +1 (017) 555-7713 or +1### (017)*** 555-7713; pay 4111 1111 1111 1111 or 4111111111111111, ssn 123-45-6789, from 10.0.0.1",
        "Mr. John Smith met Mary Smith and JOHN SMITH. Иван Петров saw Frau Schmidt. Key 0123456789ABCDEF0123456789ABCDEF01234567",
    )
    x, y, z = re.findall(r"\S+@[\w.]+\w", a)
    assert x.lower() == y.lower() != z.lower() and y == y.upper() and x.split("@")[1].lower() == z.split("@")[1].lower()
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@[a-z]{4}\.[a-z]{7}\.com", x)
    p, q = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1### \(\d{3}\)\*\*\* \d{3}-\d{4});", b).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713"
    m, n = re.search(r"pay (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15}),", b).groups()
    assert m.replace(" ", "") == n != "4111111111111111" and luhn(n)
    assert "123-45-6789" not in b and re.search(r"ssn \d{3}-\d{2}-\d{4}", b) and "10.0.0.1" not in b
    given, family, other, again = re.search(r"^Mr\. (\w+) (\w+) met (\w+) (\w+) and", c).groups()
    assert family == again and given in pii.GIVEN["m", "latin"] and given != "John" and other in pii.GIVEN["f", "latin"] and other != "Mary"
    assert re.search(r"Frau [A-Z][a-z]+\.", c) and "Schmidt" not in c and "Smith" not in c
    ru = re.search(r"([Ѐ-ӿ]+) ([Ѐ-ӿ]+) saw", c).groups()
    assert ru[0] in pii.GIVEN["m", "cyrillic"] and ru != ("Иван", "Петров")
    assert re.search(r"Key [0-9A-F]{40}$", c) and "0123456789ABCDEF" not in c


def test_surrogates_stay_distinct_in_a_crowded_space(spark):
    rows = [("email", f"{x}@{d}.com") for x in "abcdefghijklmnopqrstuvwxyz" for d in "pq"] + [("ip", f"10.0.0.{i}") for i in range(200)] + [("given-m-latin", n.lower()) for n in pii.GIVEN["m", "latin"]] + [("family", f"n{i}") for i in range(3000)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string")).collect()
    assert len(got) == len(rows)
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(rows)
    real = {r for r in rows if not r[0].startswith("given")}
    assert not real & {(r["kind"], r["surrogate"]) for r in got}
    assert all(r["surrogate"] != r["norm"] for r in got)
    other = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "another key").collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in got}


def test_full_spaces_trade_places(spark):
    rows = [("phone", f"+49 {i:04d}") for i in range(10_000)] + [("phone", f"+33 {i:06d}") for i in range(200)] + [("ip6", f"::{i:x}") for i in range(16)] + [("phone", f"{i:07d}") for i in range(50)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string")).collect()
    assert sorted((r["kind"], r["norm"]) for r in got) == sorted(rows)
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(rows) and all(r["surrogate"] != r["norm"] for r in got)
    sparse = [r for r in got if r["norm"].startswith("+33") or len(r["norm"]) == 7 and r["norm"].isdigit()]
    assert len(sparse) == 250 and not {r["surrogate"] for r in sparse} & {n for _, n in rows}
    assert all(r["surrogate"][:4] == "+49 " and len(r["surrogate"]) == 8 for r in got if r["norm"].startswith("+49"))


def test_other_written_forms(spark):
    forms = {
        "+14155552671": r"\+1\d{10}", "+49 1701234567": r"\+49 \d{10}", "555.123.4567": r"\d{3}\.\d{3}\.\d{4}", "(555)123-4567": r"\(\d{3}\)\d{3}-\d{4}", "1-800-555-1234": r"\d-\d{3}-\d{3}-\d{4}",
        "3782 822463 10005": r"3\d{3} \d{6} \d{5}", "2001:db8::8a2e:370:7334": r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}", "a" * 200: "[0-9a-f]{200}",
        "John O'Brien": r"\w+ \w+", "James T. Kirk": r"\w+ T\. \w+", "Mary Jane Watson": r"\w+ \w+ \w+", "Anna Smith-Jones": r"\w+ \w+",
    }
    got = replaced(spark, *[f"see {f}, as it is" for f in forms])
    for (form, shape), text in zip(forms.items(), got):
        assert form not in text and re.fullmatch(rf"see {shape}, as it is", text), (form, text)
    a, b = replaced(spark, "call +1 415 555 2671", "call +14155552671")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "14155552671"
    same = ["std::abc at 12:30:45, ratio 3:4", "+++ 1.234.567 and 12.5", "version 2.10.1, a::b"]
    assert replaced(spark, *same) == same


def test_odd_rows(spark):
    rows = [*edge_rows(), (20, "a@b.co a@b.co"), (20, "a@b.co a@b.co"), (None, "x 1.2.3.4"), (21, "1.2.3.4.5 99999999999999999999 a@b @c.de 1.2.3.999")]
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"], r["text"]) for r in pii.replace(docs).collect()), key=repr)
    assert len(got) == len(rows)
    changed = [x for x in got if x[0] == 20]
    assert changed[0] == changed[1] and len(set(changed[0][1].split())) == 1 and "a@b.co" not in changed[0][1]
    assert [x for x in got if x[0] == 21] == [rows[-1]]
    same = {i: t for i, t in rows if i in (1, 2, 3, 4, 6, 7, 8, 9)}
    assert all(t == same[i] for i, t in got if i in same)
    wide = crowded(docs)
    assert set(pii.replace(wide).columns) == set(wide.columns) and pii.replace(wide).count() == len(rows)
    assert pii.replace(documents(spark, [])).count() == 0


def test_main_path_runs_no_python(spark):
    plan = pii.replace(documents(spark, [(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
