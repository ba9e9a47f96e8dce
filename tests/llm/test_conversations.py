import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakeaccord.llm import conversations as cv
from lakeaccord.llm.queries import QUERIES
from tests.oracle import compare

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FOLDER = "/root/testdata/sf0.001"


def cheapest(initials, faults):
    """All four states of the grammar, turn by turn, with the least (cost, audit) of each."""
    best = {"": (0, "")}

    def filled(states):
        out = dict(states)
        for frm, to in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("a", "u")):
            if frm in out:
                c, a = out[frm]
                out[to] = min(out.get(to, (1 << 60, "")), (c + 3, a + "I"))
        return out

    for role, fault in zip(initials, faults, strict=True):
        new = {}

        def put(state, cost, audit, new=new):
            new[state] = min(new.get(state, (1 << 60, "")), (cost, audit))

        for state, (c, a) in filled(best).items():
            put(state, c + 4, a + "D")
            if fault in (cv.BLANK, cv.REPEATED):
                continue
            c += 3 * (fault == cv.TRUNCATED)
            want = "a" if state == "u" else "u"
            if role == want:
                put(want, c, a + "K")
            if role == "s" and state == "":
                put("s", c, a + "K")
            put(want, c + 3, a + "R")
        best = new
    last = filled(best)
    return min(last[s] for s in ("", "a") if s in last)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_agrees_with_a_walk_of_the_grammar(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(cv, "STEP", 7)
    for _ in range(400):
        n = rng.randrange(0, 30 if rng.random() < 0.2 else 9)
        kinds = rng.choice(["sua", "ua", "u", "s.ua", "s", "."])
        initials = "".join(rng.choice(kinds) for _ in range(n))
        faults = bytes(rng.choice([0, 0, 0, 1, 2, 3, 3]) for _ in range(n))
        assert cv.align(initials, faults) == cheapest(initials, faults), (initials, faults)


def test_long_alternation_with_few_faults_stays_in_a_narrow_band():
    rng = random.Random(1)
    n = 6000
    initials = "".join("ua"[i % 2] if rng.random() > 0.01 else "u" for i in range(n))
    faults = bytes(rng.choice([0] * 60 + [1, 2, 3]) for _ in range(n))
    assert cv._Table(initials, faults).width < n / 4
    assert cv.align(initials, faults) == cheapest(initials, faults)


def expected(rows):
    """The contract, row by row, without Spark."""
    hurt = {}
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        hurt.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, turns in hurt.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, faults, white = set(), [], "\t\n\x0b\x0c\r "
        for _, role, text in turns:
            rest = text.rstrip(white)
            faults.append(1 if not rest else 2 if (role, text) in seen else 3 if rest[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "." for _, r, _ in turns)
        cost, audit = cheapest(initials, faults)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        left, lines, last = iter(turns), [], ""
        for edit in audit:
            if edit != "I":
                _, role, text = next(left)
            if edit == "D":
                continue
            want = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[want]
            lines.append(f"{name}:" if edit == "I" else f"{name}:{text}" if edit == "R" else f"{role}:{text}")
            last = role[0] if edit == "K" else want
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, sha)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows(seed=0):
    rng = random.Random(seed)
    texts = [None, "", " \n\t\x0b", "Yes.", "No", "Ärger und Öl! \n", "same.", "same.", "x" * 100_000, "?", "a:b\nc.", "end "]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "s", "über"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 12)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(2500)]  # a third of all rows and more
    rows += [(200, 1, "user", "again.")] * 30
    rows += [(300 + i, 0, "user", "hm.") for i in range(100)]  # some lose their only turn
    return rows


def test_figures_agree_with_the_contract(spark, tmp_path):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"audit": F.lit("x"), "digest": F.lit(1), "is_turn": F.lit(2), "cost": F.lit("y")})
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in QUERIES["op11_conversation_repair"][0](spark, str(tmp_path)).collect()}
    wanted = expected(rows)
    assert found == wanted
    assert any(audit == "" for *_, audit, _ in wanted.values()) and {"D", "I", "K", "R"} <= set("".join(w[6] for w in wanted.values()))


def test_repaired_turns_alternate_and_follow_the_audit(spark):
    frame = spark.createDataFrame(odd_rows(3), SCHEMA)
    audits = cv.audits(frame)
    rows = cv.repaired(frame, audits).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by.setdefault(r["conv_id"], []).append(r)
    for a in audits.collect():
        own = by.get(a["conv_id"], [])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert "".join(r["edit"] for r in own) == a["audit"].replace("D", "")
        roles = "".join(r["role"][0] for r in own)
        rest = roles[1:] if roles.startswith("s") else roles
        assert roles == "" or (rest and rest == "ua" * (len(rest) // 2))
        assert all(r["text"] == "" and r["role"] in ("user", "assistant") for r in own if r["edit"] == "I")


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    found = cv.audits(frame)
    assert found.count() == 0 and cv.digests(frame, found).count() == 0 and cv.repaired(frame, found).count() == 0


def test_query_agrees_with_sql(spark):
    run, sql = QUERIES["op11_conversation_repair"]
    assert compare(spark, FOLDER, run, sql)["problem"] == ""
