"""Filter audits, repaired conversations and similar shingle sets against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from crivo.llm import audit, ngram_join, queries, repair

# ---- filters


def masks(rows):
    """(id, text) -> five bits, as the contract words it."""
    least = {}
    for i, text in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text in rows:
        text, words = text or "", brute.words(text)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 re.search(r"[#$%&*|]", text) is not None, i is not None and i > least[text]]
        out.append(sum(1 << b for b, failed in enumerate(tests) if failed))
    return out


def audited(rows, labels):
    """(id, text, lang) rows -> {(part, order, step): counts}."""
    found = masks([r[:2] for r in rows])
    out = {}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {r[2] or "" for r in rows}:
        docs = [(m, labels.get(r[0], (0, 0))) for m, r in zip(found, rows) if (r[2] or "") == part]
        first = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone, kept = [d for d in left if d[0] & bit], [d for d in left if not d[0] & bit]
                failing = [d for d in docs if d[0] & bit]
                first[letter] += len(gone)
                out[part, order, step] = [len(kept), len(gone), len(failing) - len(gone), sum(d[0] == bit for d in docs),
                                          sum(d[1][0] for d in gone), sum(d[1][1] for d in gone)]
                left = kept
        for order in orders:
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(first[letter])
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def texts(rng, n):
    """Texts of which many are copies, begin alike, are empty, or fail a filter."""
    begun = "This line starts many of the texts " * 40
    said = ["", " \n", begun, begun + "a", "é" * 50, "x # y"]
    said += [" ".join(rng.choice(["Aa", "b", "C", "dd", "e|", "f"] if k % 2 else [f"w{j}" for j in range(900)]) for _ in range(rng.choice([3, 150, 260]))) for k in range(40)]
    said += [begun + s for s in said[6:20]]
    return [rng.choice(said) if rng.random() < 0.7 else rng.choice(said) + str(i % 7) for i in range(n)]


def test_every_order_of_filters(spark):
    rng = random.Random(4)
    said = texts(rng, 300)
    rows = [(rng.randrange(200) if i % 17 else None, None if t == "" and i % 2 else t, rng.choice(["en", "de", None])) for i, t in enumerate(said)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(0, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id": F.lit("x"), "mask": F.lit(3), "n": F.lit(9), "part": F.lit("p"), "key": F.lit(1)})
    known = {}
    for i, good, toxic in labels:
        if i is not None:
            known[i] = (max(known.get(i, (0, 0))[0], good or 0), max(known.get(i, (0, 0))[1], toxic))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"part": F.lit(1), "n": F.lit(2)})
    for most in (None, 2000):
        found = audit.interactions(audit.labelled(audit.masks(docs.repartition(5), most_bytes=most), said))
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in found.collect()}
        assert got == audited(rows, known)


def test_prefixes_grow_only_where_texts_begin_alike(spark):
    begun = "z" * 3000
    rows = spark.createDataFrame([(begun + str(i),) for i in range(50)] + [(f"{i} other",) for i in range(50)], "text string").select(F.col("text").cast("binary"))
    found, total = audit.keyed(rows, 20_000)
    sizes = {len(r["key"]) for r in found.where(F.col("text").cast("string").startswith("z")).select("key").collect()}
    assert min(sizes) > 3000 and total == sum(len(begun + str(i)) + len(f"{i} other") for i in range(50))
    assert found.where(~F.col("text").cast("string").startswith("z")).agg(F.max(F.octet_length("key"))).first()[0] < 16


def test_no_documents_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.labelled(audit.masks(none), labels)).count() == 0


# ---- conversations

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def judged(rows):
    """Each row's first fault, and whether it is truncated."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        cut = last not in (["."], ["!"], ["?"])
        out.append(("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if cut else None, cut))
        seen.add((role, text))
    return out


def choices(rows, faults):
    """Cost, letters and result of every sequence of edits with up to two insertions in a place."""
    done = []

    def go(i, cost, letters, result):
        # An empty role has no letter that may stay.
        initials = "".join(r[:1] or "?" for r, _ in result)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows):
            places = [(cost, letters, result)]
            for k in (1, 2):
                places += [(cost + 5 * k, letters + "I" * k, result + list(extra)) for extra in itertools.product([("user", ""), ("assistant", "")], repeat=k)]
            done.extend(p for p in places if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in p[2])))
            return
        for k in (0, 1, 2):
            for extra in itertools.product([("user", ""), ("assistant", "")], repeat=k):
                before, c, a = result + list(extra), cost + 5 * k, letters + "I" * k
                (_, role, text), (fault, cut) = rows[i], faults[i]
                go(i + 1, c + 2, a + "D", before)
                if fault not in ("blank", "duplicate"):
                    go(i + 1, c + 5 * cut, a + "K", before + [(role, text)])
                    for other in ("user", "assistant"):
                        go(i + 1, c + 1 + 5 * cut, a + "R", before + [(other, text)])

    go(0, 0, "", [])
    return done


def summary(conv, rows, best):
    faults = judged(rows)
    turns = sorted({r[0] for r in rows if r[0] is not None})
    kinds = [f for f, _ in faults]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, result = best
    said = "\n".join(f"{r}:{t}" for r, t in result)
    return (conv, turns[-1] - turns[0] + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            illegal, cost, letters, hashlib.sha256(said.encode()).hexdigest())


def cheapest(rows, faults):
    """By costs and letters as tuples, state by state: for long conversations."""
    into = {0: 2, 1: 2, 2: 3, 3: 2}
    role_of = {2: "user", 3: "assistant"}
    best = {0: (0, "", [])}

    def inserted(best):
        for _ in range(2):
            for s, (c, a, r) in list(best.items()):
                new = (c + 5, a + "I", r + [(role_of[into[s]], "")])
                if into[s] not in best or new[:2] < best[into[s]][:2]:
                    best[into[s]] = new
        return best

    for (_, role, text), (fault, cut) in zip(rows, faults):
        after = {}
        for s, (c, a, r) in inserted(best).items():
            options = [(s, (c + 2, a + "D", r))]
            if fault not in ("blank", "duplicate"):
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                options += [(keep, (c + 5 * cut, a + "K", r + [(role, text)]))] if keep else []
                options += [(into[s], (c + 1 + 5 * cut, a + "R", r + [(role_of[into[s]], text)]))]
            for t, new in options:
                if t not in after or new[:2] < after[t][:2]:
                    after[t] = new
        best = after
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])


CONV = "conv_id long, turn long, role string, text string"
SAID = ["Yes.", "No", " ", "What?", "\t", "Fine!", "and so", "Yes."]


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_short_conversations_by_every_choice(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "usher"]), rng.choice([*SAID, None]))
            for c in range(120) for t in rng.sample(range(9), rng.randrange(1, 4))]
    want = []
    for c in range(120):
        mine = damaged([r for r in rows if r[0] == c])
        found = min(choices(mine, judged(mine)), key=lambda f: f[:2])
        want.append(summary(c, mine, found))
    found = repair.repaired(repair.damage(spark.createDataFrame(rows, CONV).repartition(3)))
    assert results(found) == sorted(want, key=str)


def test_long_and_odd_conversations(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(700)]), rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice([*SAID, f"t{i}.", "long. " * 5000]))
            for i in range(1500)]
    rows += [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 5, "user", "Same."), (4, None, "user", "a."), (4, None, "assistant", "b.")]
    # Only users and blanks: paths stay apart for very long.
    rows += [(6, t, "user", f"{t}." if t % 3 else "") for t in range(400)]
    rows += [(c, 0, "user", "x") for c in range(100, 160)]
    want = []
    for c in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == c])
        want.append(summary(c, mine, cheapest(mine, judged(mine))))
    turns = spark.createDataFrame(rows, CONV).withColumns({"conv": F.lit("x"), "copies": F.lit(5), "seen": F.lit(True)})
    found = repair.repaired(repair.damage(turns))
    assert results(found) == sorted(want, key=str)
    assert any(w[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for w in want if (w[0] or 0) >= 100)
    assert repair.repaired(repair.damage(turns.limit(0))).count() == 0


@pytest.mark.parametrize("width", [16, 96])
def test_weights_of_any_width_decide_alike(width):
    rng = random.Random(width)
    for _ in range(40):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(SAID) + str(t) + rng.choice(".,")) for t in range(rng.randrange(1, 90))]
        faults = judged(rows)
        path = repair.Path(width)
        for (_, role, text), (fault, cut) in zip(rows, faults):
            path.row(role.encode(), text.encode(), fault in ("blank", "duplicate"), cut)
        cost, letters, result = cheapest(rows, faults)
        assert path.end() == (cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest())


def test_all_conversations_come_back(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = []
    for c in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == c])
        want.append(summary(c, mine, cheapest(mine, judged(mine))))
    assert results(queries.op12_repair(spark, small_dir)) == sorted(want, key=str)


# ---- similar sets

def sets(rows, width=4):
    out = []
    for _, text in rows:
        words = brute.words((text or "").translate(brute.LOWER))
        out.append({tuple(words[i:i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set())
    return out


def linked(rows):
    """(id, size, component) by all pairs."""
    found = sets(rows)
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            common = len(x & found[j])
            if x and 100 * common >= 85 * (len(x) + len(found[j]) - common) and top(i) != top(j):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = [v for v in (doc, least.get(top(i))) if v is not None]
        least[top(i)] = min(known) if known else None
    return sorted(((doc, len(x), least[top(i)] if x else doc) for i, ((doc, _), x) in enumerate(zip(rows, found))), key=str)


def similar_texts(rng, families):
    rows = []
    for f in range(families):
        words = [rng.choice(["Of", "and", f"w{rng.randrange(3000)}", f"v{rng.randrange(3000)}"]) for _ in range(rng.choice([1, 3, 5, 9, 12, 30, 80, 200, 450]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(copy[rng.randrange(0, 2):]) + rng.choice(["", " ", "\n" + "shared line of many of the texts here " * 2]))
    return rows


@pytest.mark.parametrize("crowded", [1000, 3])
def test_similar_sets_are_all_found(spark, crowded, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "BLOCK", 2 if crowded == 3 else 1024)
    rng = random.Random(11)
    said = similar_texts(rng, 220)
    rows = [(rng.randrange(3000) if i % 29 else None, t) for i, t in enumerate(said)]
    rows += [(7, None), (8, ""), (9, " \n"), (8, ""), (10, said[0].upper()), (10, said[0].upper()), (12, "x\x00y z\x1f a b c"), (5000, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "node", "n", "tile", "a", "b")})
    found = ngram_join.classes(docs.repartition(4))
    want = linked(rows)
    assert len({w[2] for w in want}) < len(want) - 50
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_similar_documents(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_jaccard(spark, small_dir).collect()), key=str) == linked(rows)


def test_no_texts_no_links(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_tiles_and_pass_the_bound():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (6, 7, 8, 13, 40, 100, 351, 352, 353, 2000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = int(ngram_join.differ(2 * n))
            gone = rng.integers(0, most // 2 + 1)
            y = np.unique(np.append(x[gone:], rng.integers(0, 1 << 63, rng.integers(0, most - gone + 1), dtype=np.uint64)))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (len(x) + len(y) - common) or (len(x) == len(y) == common):
                continue
            lain = [set(np.concatenate([ngram_join.tiles(s, b)[0] for b in (ngram_join.band_of(len(s)), ngram_join.band_of(len(s)) - 1) if b >= 0]).tolist()) for s in (x, y)]
            assert lain[0] & lain[1]
            a, b = ngram_join.signature(x), ngram_join.signature(y)
            words = min(len(a), len(b))
            apart = int(np.bitwise_count(ngram_join.folded(a[None], words) ^ ngram_join.folded(b[None], words)).sum())
            assert apart <= ngram_join.differ(len(x) + len(y))


@pytest.mark.parametrize("few", [64, 1])
def test_small_and_large_tiles_find_the_same(spark, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "CROWDED", 5)
    rng = random.Random(12)
    rows = list(enumerate(similar_texts(rng, 90)))
    lines = [" ".join(f"l{k}w{i}" for i in range(30)) for k in range(6)]
    rows += [(1000 + i, " ".join(rng.sample(lines, 5)) + f" end {i % 7}") for i in range(60)]
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=str) == linked(rows)


def test_signatures_are_not_sent_with_every_tile(spark, monkeypatch):
    rng, rows, sent = random.Random(13), [], []
    for family in range(30):
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(4):
            at = rng.randrange(370)
            rows.append((len(rows), " ".join(words[:at] + [f"x{rng.randrange(10**6)}" for _ in range(22)] + words[at + 22:])))
    blocks = ngram_join._blocks

    def counted(mixed, forest):
        sent.append(mixed.count())
        return blocks(mixed, forest)

    monkeypatch.setattr(ngram_join, "_blocks", counted)
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == linked(rows)
    assert len(sent) == 2 and sum(sent) <= len(rows)


def test_similar_sets_have_so_many_parts_alike():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (6, 8, 13, 40, 100, 351, 352, 420, 2000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, ngram_join.differ(2 * n) // 2 + 1))
            y = np.unique(np.append(x[gone:], rng.integers(0, 1 << 63, rng.integers(0, gone + 1), dtype=np.uint64)))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (len(x) + len(y) - common) or len(x) == len(y) == common:
                continue
            band = ngram_join.band_of(min(len(x), len(y)))
            (a, none), (b, other) = ngram_join.tiles(x, band), ngram_join.tiles(y, band)
            alike = len(set(a.tolist()) & set(b.tolist())) + min(none, other)
            assert alike >= ngram_join.alike(band, len(x) + len(y)) >= ngram_join.EQUAL
            for s in (x, y):
                own = ngram_join.band_of(len(s))
                least = ngram_join.alike(band, len(s) + (100 * len(s) // 85 if own == band else ngram_join.largest(band)))
                assert alike >= least
