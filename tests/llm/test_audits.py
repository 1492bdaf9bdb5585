"""The filter audit, personal data and turn repair against brute force and hand-made cases."""

import hashlib
import random
import re
import time
import zlib
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from creel.llm import filter_audit, pii, queries, turn_repair

SF = "/root/testdata/sf0.001"


# --- filter audit


def audited(docs, labels):
    """Counts by walking through every order, document by document."""
    least, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in docs:
        text = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        marks = [x for x in labels if x[0] == i and i is not None]
        good, toxic = any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((lang or "", "".join(order), step), dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], 0))
                row["redundant"] += gone and fails[f]
                if not gone and fails[f]:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += good
                    row["toxic_lost"] += toxic
                row["kept"] += not gone
                row["unique_fails"] += sum(fails.values()) == 1 and fails[f]
    total = {}
    for (part, order, step), row in out.items():
        at = part, order[step - 1]
        total[at] = total.get(at, 0) + row["removed"]
    return {k: (*v.values(), total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts(r):
    plain = " ".join(f"w{i}" for i in range(220))
    return [None, "", " \n", "short", plain, plain, "Same " * 250, plain + " #", plain.upper(), "A" * 9000, plain + " extra", "$ " * 300, plain.title() + " %"][r.randrange(13)]


def test_audit_equals_a_walk_through_every_order(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 8)  # some groups are hot here
    r = random.Random(1)
    docs = [(i, texts(r), r.choice(["en", "fr", "", None])) for i in range(60)] + [(None, texts(r), "en") for _ in range(4)] + [(7, "short", "en")] * 2
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    df = df.withColumn("hash", F.lit("x")).withColumn("part", F.lit(1)).withColumn("failed", F.lit(0)).withColumn("n", F.lit(9)).withColumn("id", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    rows = filter_audit.filter_audit(df, marks).collect()
    got = {tuple(x[:3]): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in rows}
    assert len(got) == len(rows) and got == audited(docs, labels)
    assert filter_audit.filter_audit(df.limit(0), marks).count() == 0


def test_copies_are_joined_without_a_pass_over_pairs(spark):
    df = spark.createDataFrame([(i, "one text for all") for i in range(3000)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.combinations(df, labels).collect()
    assert sorted((x.failed, x.n) for x in found) == [(1, 1), (17, 2999)]


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    found = [("email", m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted((s, pii.KINDS.index(k), e) for k, (s, e) in found)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_plain_patterns(seed):
    r = random.Random(seed)
    signs = list("ab1234567890.@-+ ()_%é\n") + ["@", ".", "4111111111111111", "+1 (743) 555-3824", "8.196.197.208", "a.b@c.de", "😀", "١", "DE89370400440532013000"]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(45)))
        got = [(x.start, x.kind, x.end) for x in pii.find(text) if x.kind < len(pii.BASE)]
        assert got == base_spans(text), text


def test_query_on_every_document_equals_the_plain_patterns(spark):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for x in rows:
        want = base_spans(docs[x.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(told.split(",")) - {""} <= set(x.spans.split(","))


def test_added_kinds_need_their_checks_and_words():
    kinds = lambda t: [(pii.KINDS[x.kind], t[x.start : x.end]) for x in pii.find(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert kinds("GB83WEST12345698765432") == [] and kinds("xGB82WEST12345698765432") == []
    assert kinds("her SSN is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789") == [] and kinds("SSN 666-45-6789") == [] and kinds("123-45-6789") == []
    assert kinds("Telefon: 030 1234 5678") == [("tel", "030 1234 5678")]
    assert kinds("chapter 030 1234 5678") == []


def test_words_nearby_move_the_score():
    one = lambda t: pii.find(t)[0].score
    assert one("visa 4111111111111111") > one("4111111111111111") > one("isbn 4111111111111111")
    assert one("version 1.2.3.4") < one("1.2.3.4") < one("server 1.2.3.4")
    assert one("isbn" + " " * 60 + "4111111111111111") == one("4111111111111111")


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "x " * 50 + "+1 (743) 555-3824")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("__text", F.lit("q"))
    got = sorted((x.doc_id or 0, x.n_email, x.n_phone, x.spans, x.redacted) for x in pii.pii(df).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(0, 0, 1, "phone:100:117", "x " * 50 + "[phone]"), (1, 0, 0, "", None), (2, 0, 0, "", ""), (3, 1, 0, "email:0:5", "[email]"), (3, 1, 0, "email:0:5", "[email]")]
    assert pii.pii(df.where("text = ''")).first().base_sha256 == none
    assert pii.pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["1", "x", "a@", "1.", "+1 ", "+1(", "1-", "a.b@c.", "DE12 ", "(12) ", "..@", "@a.b"])
def test_time_grows_with_the_text_only(unit):
    start = time.time()
    pii.find(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 20


# --- turn repair


def every_repair(rows):
    """Least cost and audit by trying edits up to a length, cheapest first."""
    best = (3 * len(rows), "D" * len(rows))
    good = re.compile(r"(s?(ua)+)?")
    for n in range(len(rows) + 4):
        for edits in product("DIKR", repeat=n):
            if n - edits.count("I") != len(rows):
                continue
            cost, says, at = 0, [""], 0
            for e in edits:
                if e == "I":
                    cost += 2
                    says = [s + c for s in says for c in "ua"]
                    continue
                row = rows[at]
                at += 1
                if e == "D":
                    cost += 3
                elif row == "d":
                    says = []
                else:
                    cost += row.isupper() + 2 * (e == "R")
                    says = [s + row.lower() for s in says] if e == "K" else [s + c for s in says for c in "ua"]
            if any(good.fullmatch(s) for s in says):
                best = min(best, (cost, "".join(edits)))
    return best


def test_repair_is_the_cheapest_of_all_edits():
    r = random.Random(5)
    cases = ["", "s", "u", "a", "ua", "sua", "au", "uu", "uuaa", "dd", "Sx"] + ["".join(r.choice("suaSUAxXd") for _ in range(r.randrange(1, 5))) for _ in range(70)]
    for codes in cases:
        assert turn_repair.repair(codes) == every_repair(codes), codes


def test_blocks_give_what_one_table_gives(monkeypatch):
    r = random.Random(6)
    for _ in range(60):
        codes = "".join(r.choice("suuuaaaUAxd") for _ in range(r.randrange(3, 20)))
        monkeypatch.setattr(turn_repair, "BLOCK", 40)
        whole = turn_repair.repair(codes)
        for size in (1, 2, 3, 7):
            monkeypatch.setattr(turn_repair, "BLOCK", size)
            assert turn_repair.repair(codes) == whole, (codes, size)


def test_long_conversation():
    codes = ("sua" + "ua" * 20 + "uxAd") * 500
    start = time.time()
    cost, audit = turn_repair.repair(codes)
    assert time.time() - start < 60 and len(audit) >= len(codes) and cost > 0


def by_hand(rows):
    """The contract on plain lists: (conv_id, turn, role, text) to the row of each conversation."""
    groups = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        c_, t_ = (" " if x is None else str(x) for x in (c, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        groups[c] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, said in groups.items():
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [x[0] for x in said if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        codes, seen = "", set()
        for _, role, text in said:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "b" if not solid else "d" if (role, text) in seen else initial if solid[-1] in ".!?" else initial.upper()
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:], strict=False)]
        cost, audit = turn_repair.repair(codes.replace("b", "d"))
        odd, turn, at, told = (len(audit) - audit.count("D")) % 2, 0, 0, []
        for e in audit:
            name = ("user", "assistant")[(turn - odd) % 2]
            if e == "K":
                told.append(f"{said[at][1]}:{said[at][2]}")
            elif e == "R":
                told.append(f"{name}:{said[at][2]}")
            elif e == "I":
                told.append(f"{name}:")
            at += e != "I"
            turn += e != "D"
        sha = hashlib.sha256("\n".join(told).encode()).hexdigest()
        out[c] = (gaps, codes.count("b"), codes.count("d"), sum(x.isupper() for x in codes), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def test_query_equals_the_contract_by_hand(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x)[1:] for x in queries.op13_turn_repair(spark, SF).collect()}
    assert got == by_hand(rows)


def test_odd_conversations(spark):
    r = random.Random(7)
    said = ["Yes.", "no", " ", "", None, "Yes.  ", "Fine!\n", "a\nb?"]
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, 9, None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(said)) for _ in range(60)]
    rows += [(4, None, None, None), (5, 0, "user", "x" * 100000)] + [(6, i, "user", "again.") for i in range(100)] + rows[:5]
    rows += [(c, 0, "user", "Hi.") for c in range(10, 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(0)).withColumn("audit", F.lit("x")).withColumn("key", F.lit(1))
    got = turn_repair.turn_repair(turn_repair.damaged(df), df).collect()
    want = by_hand(rows)
    assert len(got) == len(want) and {x.conv_id: tuple(x)[1:] for x in got} == want
    assert any(v[6] == "" for v in want.values())
    assert turn_repair.turn_repair(df.limit(0)).count() == 0
