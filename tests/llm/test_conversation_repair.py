"""Conversation repair against brute force: every edit list for short conversations, whole lists per state for long ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from assayframe.llm import conversation_repair as repair

COLUMNS = "conv_id long, turn long, role string, text string, kind string, code string, audit string, place long"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        shown = [" " if x is None else str(x) for x in (conv_id, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(":".join(shown).encode()) % 20
        mine = out[conv_id]
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        mine += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    name = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), name(r))) for c, m in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Whole edit lists, one for each last letter: (cost, audit, repaired rows)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, text) in list(best.items()):
                new = follow[last]
                entry = (cost + 3, audit + "I", text + ((full[new], ""),))
                if new not in best or entry[:2] < best[new][:2]:
                    best[new] = entry
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, found):
        later = {}

        def offer(last, cost, audit, made):
            if last not in later or (cost, audit) < later[last][:2]:
                later[last] = cost, audit, made

        for last, (cost, audit, made) in best.items():
            offer(last, cost + 4, audit + "D", made)
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            for last, (cost, audit, made) in inserted(dict(best)).items():
                if role[:1] == follow[last] or role[:1] == "s" and last == "":
                    offer(role[:1], cost + more, audit + "K", (*made, (role, text)))
                offer(follow[last], cost + 3 + more, audit + "R", (*made, (full[follow[last]], text)))
        best = later
    ends = inserted(dict(best))
    return min((v for k, v in ends.items() if k in ("", "a")), key=lambda v: v[:2])


def every_list(rows, found):
    """All edit lists, tried one by one."""
    inserts = [x for n in range(4) for x in itertools.product("ua", repeat=n)]
    full, best = {"u": "user", "a": "assistant"}, None
    for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(found, edits)):
            continue
        for between in itertools.product(inserts, repeat=len(rows) + 1):
            letters, cost, audit, made = "", 0, "", []
            for i in range(len(rows) + 1):
                letters += "".join(between[i])
                audit += "I" * len(between[i])
                cost += 3 * len(between[i])
                made += [(full[x], "") for x in between[i]]
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (found[i] == "truncated" and e != "D")
                    if e != "D":
                        role = role if e == "K" else full[e[1]]
                        letters += role[:1] or "?"
                        made.append((role, text))
            if LEGAL.fullmatch(letters) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, tuple(made)
    return best


def plain(rows, solve=cheapest):
    out = []
    kept = after_damage(rows)
    for conv_id in {r[0] for r in rows}:
        mine = kept[conv_id]
        found = faults(mine)
        cost, audit, made = solve(mine, found)
        turns = {t for t, *_ in mine if t is not None}
        letters = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv_id, gaps, *[found.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return Counter(out)


def hard_rows():
    rng = random.Random(3)
    texts = ["Yes.", "Yes.", "No", "", " \t\n", None, "Why?", "Tell me more!", "cut. \x0b ", "cut off", "a.b", "¿Qué?", "…", " "]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "User", "usher"]
    rows = []
    for conv in range(150):
        turns = sorted(rng.sample(range(12), rng.randint(0, 6)))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts), "k", None, "a", 1) for t in turns]
    rows += [(500, t, "user", "Again.", None, None, None, None) for t in range(40)]
    rows += [(501, t, rng.choice(roles[:5]), f"Line {t}{rng.choice('.?x')}", None, None, None, None) for t in range(700)]
    rows += [(None, t, "user", "Hm.", None, None, None, None) for t in (None, 1, 1, 5)] + [(502, None, None, None, None, None, None, None)]
    return rows + rows[3:6]


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return Counter(tuple(r) for r in df.collect())


def test_hard_rows(spark):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert result(repair.repaired_conversations(docs)) == plain(rows)


def test_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/conversations.parquet")
    assert result(repair.repaired_conversations(docs)) == plain([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


def test_every_edit_list_of_short_conversations():
    roles, texts = ["system", "user", "assistant", "tool"], ["Yes.", "cut", ""]
    rng, pairs = random.Random(1), list(itertools.product(roles, texts))
    cases = [[a] for a in pairs] + [list(x) for x in itertools.product(pairs, pairs)][::5] + [[rng.choice(pairs[:9]) for _ in range(3)] for _ in range(2)]
    for case in cases:
        rows = [(i, *x) for i, x in enumerate(case)]
        found = faults(rows)
        cost, audit, _ = every_list(rows, found)
        kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        codes = bytes(4 * ("sua".index(r[0]) if r[0] in "sua" else 3) + kinds[f] for (_, r, _), f in zip(rows, found))
        assert repair.repair(codes) == (cost, audit), case
        assert cheapest(rows, found)[:2] == (cost, audit), case


def test_random_codes_against_whole_lists():
    rng = random.Random(2)
    names = [("system", "user", "assistant", "x"), ("", "blank", "duplicate", "truncated")]
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 150] * 12:
        codes = bytes(rng.choice([0, 3, 4, 4, 4, 5, 7, 8, 8, 8, 10, 11, 12, 15]) for _ in range(n))
        rows, found = [(i, names[0][c >> 2], "") for i, c in enumerate(codes)], [names[1][c & 3] for c in codes]
        assert repair.repair(codes) == cheapest(rows, found)[:2]


def test_repaired_rows_follow_the_grammar(spark):
    rows = repair.damaged(spark.createDataFrame(hard_rows(), COLUMNS))
    plans = repair.plans(rows)
    of = defaultdict(list)
    for r in repair.repaired(rows, plans).collect():
        of[r["conv_id"]].append(r)
    audits = {r["conv_id"]: r["audit"] for r in plans.collect()}
    for conv_id, audit in audits.items():
        made = sorted(of[conv_id], key=lambda r: r["place"])
        assert [r["place"] for r in made] == list(range(1, len(made) + 1))
        assert "".join(r["edit"] for r in made) == audit.replace("D", "")
        assert LEGAL.fullmatch("".join(r["role"][:1] for r in made))
        assert all(r["text"] == "" for r in made if r["edit"] == "I")


def test_a_long_conversation_needs_no_depth():
    codes = bytes(random.Random(6).choices([4, 8, 8, 3, 5, 11, 12], k=200_000))
    cost, audit = repair.repair(codes)
    assert sum(x != "I" for x in audit) == len(codes) and cost > 0


@pytest.mark.parametrize("rows", [[], [(7, None, None, None, None, None, None, None)]])
def test_small_tables(spark, rows):
    assert result(repair.repaired_conversations(spark.createDataFrame(rows, COLUMNS))) == plain(rows)
