"""Personal data against the plain patterns of Python's re, and the SQL of the query on the same rows."""

import hashlib
import re

import duckdb
from helpers import documents, odd_documents, seeded

from rankspark.llm import personal_data, sql

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = sorted((m.start(), place, f"{kind}:{m.start()}:{m.end()}") for place, (kind, pattern) in enumerate(PLAIN.items())
                   for m in re.finditer(pattern, text or "") if holds(kind, m.group()))
    return ",".join(f[2] for f in found)


def checked(frame, rows):
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        own = ",".join(s for s in got[i].spans.split(",") if s.split(":")[0] in personal_data.BASE)
        assert own == base(text), (i, (text or "")[:80])
        assert got[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in personal_data.BASE] == [own.count(k + ":") for k in personal_data.BASE]
    return got


def test_random_texts(spark):
    rng = seeded(3)
    rows = [(i, "".join(rng.choice("ab@.@.-_ 0123456789++()  éß😀,IDE") for _ in range(rng.randint(0, 300)))) for i in range(300)]
    rows += [(5000 + i, "".join(rng.choice("0123 -.+4@a") for _ in range(rng.randint(0, 400)))) for i in range(300)]
    checked(personal_data.personal_digest(documents(spark, rows)), rows)


def test_long_runs_are_read_once(spark):
    """Runs of one character, many matches, and one match of 20 000 parts."""
    rows = [(1, "a" * 300_000 + " "), (2, "1" * 300_000), (3, "+1" + "(" * 300_000), (4, "a@" + "b." * 20_000 + "c"),
            (5, "1.2." * 8_000), (6, "é a@b.c " * 6_000)]
    frame = personal_data.personal_digest(documents(spark, rows))
    assert frame.filter("doc_id = 2").select("spans").first()[0] == ""
    checked(frame.filter("doc_id <> 1 and doc_id <> 2"), [r for r in rows if r[0] > 2])
    assert frame.filter("doc_id = 1").select("spans").first()[0] == ""


def test_added_kinds_and_scores(spark):
    rows = [
        (1, "pay DE89370400440532013000, or DE89 3704 0044 0532 0130 00 BIC X. DE88 3704 0044 0532 0130 00 is wrong"),
        (2, "my ssn: 123-45-6789"), (3, "part 123-45-6789 of it"), (4, "ssn 000-12-3456 and social 123-00-4567 and 9123-45-6789"),
        (5, "card 4111 1111 1111 1111"), (6, "order 4111 1111 1111 1111"), (7, "xDE89370400440532013000 DE89370400440532013000x"),
        (8, "version 1.2.3.4 of it"), (9, "at host 1.2.3.4")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal_data.personal_data(documents(spark, rows)).collect()}
    assert [(s[3], s[0], s[2]) for s in got[1]] == [("iban", 4, 26), ("iban", 31, 58)]
    assert [(s[3], s[0], s[2], s[4]) for s in got[2]] == [("ssn", 8, 19, 70)]
    assert got[3] == [] and got[4] == [] and got[7] == []
    assert [s[4] for s in got[5]] == [100] and [s[4] for s in got[6]] == [65]
    assert [s[4] for s in got[8]] == [40] and [s[4] for s in got[9]] == [90]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\t"), (4, "a@b.c"), (4, "a@b.c"), (None, "+1 234 567 8901")]
    out = personal_data.personal_digest(odd_documents(spark, rows))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
    assert sorted((r.doc_id or 0, r.spans) for r in out.collect()) == [
        (0, "phone:0:15"), (1, ""), (2, ""), (3, ""), (4, "email:0:5"), (4, "email:0:5")]
    assert personal_data.personal_digest(documents(spark, [])).count() == 0


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    rng, pieces = seeded(8), [
        "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ssn", "123-45-6789", "000-45-6789", "4111 1111 1111 1111", "a@b.co",
        "1.2.3.4", "999.1.2.3", "+1 (361) 555-8283", "bank", "é", "X", "test", "12", "card", "\n", "9"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice([" ", ", ", "", " x ", "-"]) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    docs = documents(spark, rows + [(700, None), (701, "")])
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    answer = con.sql(sql.PERSONAL)
    out = personal_data.personal_digest(docs).select(*answer.columns)
    assert sorted(map(tuple, out.collect())) == sorted(answer.fetchall())


def test_plan_is_native(spark):
    plan = personal_data.personal_digest(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
