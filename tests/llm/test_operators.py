import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, html_text, langid, linededup, minhash, mixing, pii, quality, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


#: Names that the operators use, or have used, for columns of their own.
NAMES = """size slot found n s p h i j v u w a b at pos word term tid shift blk off need bit got k1 k2 key_of_text second_key cut_up jk1 jk2 lid lt ln
key_0 key_1 salt_of_row salt_of_copy __k0 __salt __s __text whole_text __fp __id __t fp node first root key keys low g have a_id a_t a_text gn key_id key_text
late late_at units sizes count_of_units h1 h2 f1 f2 t id times mix_key rate frac seed_a seed_b target source_size quality_logit toxic_logit site_host site_path
label_id own_share label_quality rate_of_host rate_of_path host path hs hn site_s site_n at_slot copy_no component component_of removed n_removed pii words
contaminated n_words n_hit item_ids lang_pred score fingerprint component_id n_items taken copies p_quality lettered scored_text""".split()


def awkward(spark):
    rows = [(1, "the cat sat on a mat " * 3, "a"), (1, "the cat sat on a mat " * 3, "a"), (2, None, None), (None, "", "a"), (3, "", None), (4, "x" * 50_000, "b"), (5, "w " * 30_000, "b"), (None, "the cat sat on a mat", "a")]
    return frame(spark, rows).select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


@pytest.mark.parametrize("empty", [False, True])
def test_nulls_ties_long_texts_and_clashes(spark, empty):
    docs = awkward(spark).where("false") if empty else awkward(spark)
    n = 0 if empty else 8
    items = spark.createDataFrame([(1, "the cat sat on a mat the cat sat on a mat the"), (2, None), (None, "w w w")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")

    def kept(out, makes):
        """The rows; all columns but those that the operator makes hold what they held."""
        got = out.collect()
        for r in got:
            assert all(r[c] == f"own {c}" for c in NAMES if c not in makes), makes
        return got

    got = kept(mixing.mix_sources(docs), {"size", "source_size", "target", "copies", "taken"})
    assert len(got) == n and sorted(r.size for r in got) == ([] if empty else [0, 0, 0, 1, 6, 18, 18, 30_000])
    got = kept(sharding.assign_shards(docs), {"slot", "shard"})
    assert len(got) == n and len({r.shard for r in got if r.doc_id == 1}) == (0 if empty else 1)
    got = kept(simhash.simhash_groups(docs, keep=docs.columns), {"fingerprint", "component_id"})
    assert len(got) == n and {r.component_id for r in got if not r.text} == (set() if empty else {2}) and all(r.fingerprint == "0" * 16 for r in got if not r.text)
    got = kept(quality.classify(docs, labels), {"p_document", "host_rate", "path_rate", "p_quality", "p_toxic", "keep"})
    assert len(got) == n and len({r.p_quality for r in got if r.doc_id == 1}) == (0 if empty else 1)
    got = kept(linededup.dedup_units(docs), {"n_units", "n_removed", "removed"})
    assert len(got) == n and sorted(map(str, (r.text for r in got if r.doc_id in (1, 2, 3)))) == ([] if empty else sorted(["the cat sat on a mat " * 3] * 2 + ["None", ""]))
    assert len(kept(pii.pseudonymise(docs), {"pii"})) == n
    got = kept(langid.identify(docs, langid.train([], [])), {"lang_pred", "score"})
    assert len(got) == n and all((r.lang_pred, r.score) == ("und", 0.0) for r in got)
    got = kept(decontaminate.decontaminate(docs, items), {"n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"})
    assert sorted((r.n_words, r.n_hit, r.item_ids) for r in got) == ([] if empty else [(0, 0, [])] * 3 + [(1, 0, []), (6, 0, []), (18, 13, ["1"]), (18, 13, ["1"]), (30_000, 0, [])])
    assert [r.contaminated for r in got if r.n_hit] == ([] if empty else [True] * 2)
    for stays in (simhash.near_dedup(docs), minhash.similar_dedup(docs)):
        assert sorted(str(r.doc_id) for r in kept(stays, ())) == ([] if empty else ["1", "2", "4", "5", "None"])
    assert len(kept(mixing.emit_copies(mixing.mix_sources(docs), docs.columns), {"size", "source_size", "target", "copies", "taken"})) >= 0
    pages = docs.withColumn("html", F.col("text")).withColumn("page_id", F.col("doc_id"))
    m = html_text.train(html_text.labelled_pages(30))
    assert len(kept(html_text.extract_pages(pages, m), {"n_chars"})) == n
    vectors = docs.select("doc_id", F.array(F.lit(1.0), F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")).alias("embedding"), *NAMES)
    assert ann.nearest(vectors, F.col("doc_id") < 3, id_col="doc_id").count() == (0 if empty else 4 + 5)


def test_decontamination_against_plain_windows(spark):
    r = random.Random(5)
    vocab = ["the", "of", "ab", "cd", "éf", "gh9"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(1, 30))) for i in range(12)]
    docs = [(i, f"{text(r.randint(0, 60))} {r.choice(items)[1].upper() if i % 3 else ''} {text(r.randint(0, 300))}", "s") for i in range(40)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    got = {x.doc_id: x for x in decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t, _ in docs:
        w, hit, ids = low(t), set(), set()
        for k, q in items:
            q = low(q)
            for s in range(max(1, len(q) - 12)):
                p = q[s : s + 13]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit.update(range(a, a + len(p)))
                        ids.add(str(k))
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items) == (len(w), len(hit), len(ids))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_mixing_targets_fill_and_reruns_agree(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 5), f"s{i % 7}" if i % 11 else None) for i in range(400)])
    a, b = (sorted(map(tuple, mixing.mix_sources(docs.repartition(k)).select("doc_id", "size", "target", "taken").collect())) for k in (1, 5))
    assert a == b and all(t <= 3 * s for _, s, _, t in a)
    total = docs.join(mixing.mix_sources(docs).select("doc_id", "size"), "doc_id").agg(F.sum("size")).first()[0]
    per = {r.source: r.target for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    assert abs(sum(per.values()) - total) < 1e-6


def test_mixing_level_and_bernoulli_draws_against_plain_ones(spark):
    rows = [(i, "w " * (2000 // (1 + i // 4) + 1), [None, "b", "a", "c"][i % 4]) for i in range(600)] + [(None, "x y", "a"), (None, None, None)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    all_sizes = {s: sum(len(t.split()) for _, t, z in rows if z == s and t) for s in ("a", "b", "c", None)}
    weight, left, target = dict(zip(all_sizes, (5, 2, 1, 5))), set(all_sizes), {}
    while left:  # plain water level: those above three times their size stop there, the rest share again
        level = (sum(all_sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * all_sizes[s]}
        target |= {s: 3.0 * all_sizes[s] for s in over} if over else {s: level * weight[s] for s in left}
        left -= over or left
    for s, size in all_sizes.items():
        mine = [r for r in got if r.source == s]
        rate = target[s] / size
        frac, hashes = rate - int(rate), {}
        for r in mine:
            assert (r.source_size, r.target) == (size, pytest.approx(target[s])) and r.taken == r.size * r.copies and r.copies <= 3
            key = str(r.doc_id) if r.doc_id is not None else hashlib.md5(r.text.encode()).hexdigest() if r.text else ""
            hashes[id(r)] = int(hashlib.md5(f"{mixing.SEED}|{key}".encode()).hexdigest()[:12], 16) % mixing.PRIME
        draw = lambda a, b: {k: (h * a + b) % mixing.PRIME < frac * mixing.PRIME for k, h in hashes.items()}
        tried = [draw(a, b) for a, b in mixing.seed_numbers(mixing.SEEDS)]
        miss = [abs(sum(r.size * (int(rate) + d[id(r)]) for r in mine) - target[s]) for d in tried]
        assert {id(r): r.copies - int(rate) == 1 for r in mine} == tried[miss.index(min(miss))]
        assert min(miss) <= 0.05 * target[s]


def test_simhash_links_all_pairs_within_three_bits(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(30)} | {0}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {x.fp: x.component_id for x in simhash.fingerprint_components(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, id long")).collect()}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            break
        label = new
    assert [got[s] for s in signed] == label


def test_nearest_against_brute_force_with_ties(spark):
    r = np.random.default_rng(2)
    x = np.round(r.standard_normal((500, 8)) * 2) / 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    ok = [i for i in range(500) if x[i].any()]
    want = [(q, k + 1, c) for q in range(0, 500, 100) for k, (_, c) in enumerate(sorted((float(np.sqrt(((x[q] - x[c]) ** 2).sum())), c) for c in ok if c != q)[:10])]
    assert [(g.query_id, g.rank, g.vec_id) for g in got] == want


def test_pseudonyms_keep_format_link_and_invert():
    p, q = pii.Pseudonyms(), pii.Pseudonyms(back=True)
    t = "4207051279108084 a.b@x.org +1 (375) 555-4393 54.158.173.199 2024-02-29 28.02.2023 12/31/2020 v1.2.3 4207051279108085"
    out, found = p.text(t)
    assert [f["kind"] for f in found] == ["card", "email", "phone", "ip", "iso", "dmy", "dmy"] and out.endswith("v1.2.3 4207051279108085")
    assert len(p.text("4207051279108084 54.158.173.199 4207-0512-7910-8084")[1]) == 3
    card = out.split()[0]
    assert card != t.split()[0] and pii.luhn_digit(card[:-1]) == card[-1] and p.text(t.split()[0])[0] == card
    assert q.text(out)[0] == t


def test_line_dedup_catches_pasted_passages(spark):
    p = "Ererhe as was, thing. Heernd it the bo nor yet. Thing one two three four five six seven eight nine ten eleven."
    got = {r.doc_id: r for r in linededup.dedup_units(frame(spark, [(1, f"aa bb {p} Other words", "s"), (2, f"Short.\n{p}\nTail.", "s"), (3, "Short.\nClean text here", "s")]), min_line=linededup.QUERY_MIN_LINE).collect()}
    assert p in got[1].text and got[2].text == "Short.\nTail." and got[3].text == "Short.\nClean text here"
    assert got[2].removed[0].start == 7


def test_extraction_keeps_the_article():
    m = html_text.train(html_text.labelled_pages())
    html = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; b</h1><p>First <b>bold\n text.<p>Second<br>line here.</article><section class='comments'><p>Nice post, thanks.</p></section><footer>&copy; site</footer></body></html>"
    assert m.extract(html) == ["A & b", "First bold text.", "Second line here."] and m.extract(None) == []


def test_messages_give_the_exact_marginals():
    m = html_text.train(html_text.labelled_pages(40))
    nodes = html_text.parse("<div class=menu><p>Some text here.</p><ul><li>a</li></ul></div>")
    is_run, e, r = html_text.features(nodes)
    u = np.empty(len(nodes))
    u[~is_run], u[is_run] = e @ m.we, r @ m.wr
    total, on = 0.0, np.zeros(len(nodes))
    for s in range(1 << len(nodes)):
        y = [s >> i & 1 for i in range(len(nodes))]
        w = np.exp(sum(v * k for v, k in zip(u, y))) * np.prod([m.pair[int(x.text is not None), y[x.up], y[i]] for i, x in enumerate(nodes) if i])
        total, on = total + w, on + w * np.array(y)
    assert np.allclose(m.marginals(nodes), on / total)


def test_bptt_gradients_match_finite_differences():
    m = langid.new_model(["a", "b", "c"], 4)
    for n in ("e", "u", "bn", "v", "c"):
        setattr(m, n, getattr(m, n).astype(np.float64))
    r = np.random.default_rng(1)
    x, y, mask = r.integers(60, 80, (5, 9)), r.integers(0, 3, 5), np.arange(9) < r.integers(3, 10, (5, 1))
    _, grads = langid.loss_and_gradients(m, x, y, mask)
    for p, g, i in zip(m.params(), grads, [(2, 1, 100, 1), (2, 0, 1, 2), (0, 1), (3, 1), (2,)]):
        old, e = p[i], 1e-2
        p[i] = old + e
        up = langid.loss_and_gradients(m, x, y, mask)[0]
        p[i] = old - e
        down = langid.loss_and_gradients(m, x, y, mask)[0]
        p[i] = old
        assert abs((up - down) / (2 * e) - g[i]) < 1e-4


def test_language_model_learns_and_pools():
    r = random.Random(4)
    say = lambda a: " ".join("".join(r.choice(a) for _ in range(4)) for _ in range(40)).encode()
    texts, labels = zip(*[(say(a), n) for n, a in (("x", "abcd"), ("y", "efgh")) for _ in range(40)])
    m = langid.train(list(texts), list(labels), epochs=3)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    p = langid.pooled(m, data, np.cumsum(sizes) - sizes, sizes)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and [m.langs[k] for k in p.argmax(1)] == list(labels)


def test_lookup_table_is_even_and_moves_little():
    a, b = sharding.lookup_table(sharding.shard_names(16), 1009), sharding.lookup_table(sharding.shard_names(17), 1009)
    assert max(map(a.count, range(16))) - min(map(a.count, range(16))) <= 1
    assert sum(x != y for x, y in zip(a, b)) < 1009 * 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def brute_dedup(rows, min_line, min_run):
    """{row number: (text, removed)} by plain loops: pieces of lines, the first by (id, hash rank, place) stays."""
    import regex

    import xxhash

    cut_at = regex.compile(r"(?<=\n)|(?<=(?:\p{Ll}|\p{Ll}[.,;:!?]) )(?=\p{Lu})|(?<=[\p{Ll}\p{Lu}\p{Nd}][.!?] )(?=\p{Lu})")

    def parts(piece):
        """A long piece's words, a new part where the hash of two words is divisible by 6, or at each 32nd word without one."""
        if len(piece) <= 400:
            return [piece]
        w = [x for x in regex.split(r"(?<=\s)(?=\S)", piece) if x]
        signed = lambda x: x - (1 << 64) * (x >> 63)
        key = [xxhash.xxh64_intdigest(x.strip().lower().encode(), 42).to_bytes(8, "little") for x in w]
        marks = [i > 0 and signed(xxhash.xxh64_intdigest(key[i], xxhash.xxh64_intdigest(key[i - 1], 42))) % 6 == 0 for i in range(len(w))]
        marks = [m or i == 0 or i % 32 == 0 and not any(marks[max(0, i - 31) : i + 1]) for i, m in enumerate(marks)]
        out = []
        for x, new in zip(w, marks):
            out = [*out, x] if new else [*out[:-1], out[-1] + x]
        return out

    pieces = {i: [q for p in cut_at.split(t or "") if p for q in parts(p)] for i, t in rows}
    first, out = {}, {}
    norm = lambda u: regex.sub(r"[ \t\n\x0b\f\r]+", " ", u).lower().strip(" ")
    for i in sorted(pieces):
        for n, u in enumerate(pieces[i]):
            first.setdefault(norm(u), (i, n))
    for i, us in pieces.items():
        late = {n for n, u in enumerate(us) if norm(u) and first[norm(u)] < (i, n)}
        size, gone, at = [len(u.split()) for u in us], set(), 0
        for n, u in enumerate(us):  # whole lines
            if u.endswith("\n") or n == len(us) - 1:
                line = range(at, n + 1)
                if all(j in late or not size[j] for j in line) and sum(size[j] for j in line) >= min_line:
                    gone |= set(line)
                at = n + 1
        for a in late:  # runs: from each late unit on to the last late one before a unit with words that isn't
            b = a
            while b < len(us) and (b in late or not size[b]):
                b += 1
            run = range(a, max(j for j in range(a, b) if j in late) + 1)
            before = next((j for j in range(a - 1, -1, -1) if size[j]), None)
            if before not in late and sum(size[j] for j in run) >= min_run:
                gone |= set(run)
        starts = [sum(map(len, us[:j])) for j in range(len(us))]
        out[i] = "".join(u for j, u in enumerate(us) if j not in gone), [(starts[j], len(us[j])) for j in sorted(gone)]
    return out


@pytest.mark.parametrize("min_line,min_run", [(1, 20), (5, 20), (1, 1)])
def test_line_dedup_against_plain_loops(spark, monkeypatch, min_line, min_run):
    from tessera.plans import skew

    r = random.Random(min_line)
    word = lambda: r.choice(["ab", "Cd", "ef.", "Gh", "éa", "Éb!", "x"])
    sent = ["  ".join(word() for _ in range(r.randint(1, 9))) for _ in range(25)] + ["", " "]
    long = "\n\n".join(f"item{i} of list" for i in range(20))  # a double-spaced list of short lines
    rows = [(i, r.choice(["\n", " ", "\n\n"]).join(r.choice(sent) for _ in range(r.randint(0, 12))) + (f"\n{long}\nend{i}" if i % 4 == 0 else "")) for i in range(60)]
    want = brute_dedup(rows, min_line, min_run)
    for share in (0, 1000, 20):
        monkeypatch.setattr(skew, "HOT_SHARE", share)
        monkeypatch.setattr(linededup, "DIGESTS", 0 if share else 20_000)
        got = {x.doc_id: x for x in linededup.dedup_units(frame(spark, [(i, t, "s") for i, t in rows]), min_line=min_line, min_run=min_run).collect()}
        for i, (text, spans) in want.items():
            assert got[i].text == text and [(x.start, x.length) for x in got[i].removed] == spans and got[i].n_removed == len(spans)


def test_line_dedup_of_a_hot_line_keeps_the_first(spark):
    docs = [(i, f"one two three\nown line number w{i} x y z\none two three" if i % 3 else f"a b c d e f{i}", "s") for i in range(90)] + [(None, "one two three", "s")] * 2
    got = {r.doc_id: r for r in linededup.dedup_units(frame(spark, docs)).collect()}
    assert got[1].text == "one two three\nown line number w1 x y z\n" and got[None].text == ""
    assert sum(r.text.count("one two three") for r in got.values()) == 1


def test_nearest_of_empty_repeated_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    run = lambda rows, **k: [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, k=2, **k).orderBy("query_id", "rank").collect()]
    assert run([]) == [] and run([(1, [1.0]), (2, [2.0])]) == [] and run([(0, [1.0, 1.0])]) == []
    # Repeated candidates count each; a query row given twice is answered once; lengths other than the commonest take no part.
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [2.0, 0.0])] * 2 + [(2, [1.5, 0.0]), (100, [1.0]), (3, None), (None, [1.0, 0.0])]
    assert run(rows) == [(0, 1, 2, 0.5), (0, 2, 1, 1.0)]
    assert run(rows, query_bytes=16) == run(rows)


def test_nearest_by_blocks_and_of_close_long_vectors(spark):
    r = np.random.default_rng(7)
    far = r.standard_normal((1, 6)) * 8e6
    x = np.concatenate([far * (1 + 1e-14 * r.integers(0, 40, (300, 1))), r.standard_normal((200, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    want = []
    for q in range(0, 500, 20):
        d = np.zeros(500)
        for i in range(6):
            d += (x[q, i] - x[:, i]) ** 2
        order = sorted((float(np.sqrt(v)), c) for c, v in enumerate(d) if c != q)[:10]
        want += [(q, n + 1, c, v) for n, (v, c) in enumerate(order)]
    for query_bytes, candidates in ((1 << 24, 1 << 18), (300, 60), (100, 7), (2000, 1000)):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, query_bytes=query_bytes, candidates=candidates).orderBy("query_id", "rank").collect()
        assert [tuple(g) for g in got] == want


def test_pages_null_empty_and_clashing_columns(spark):
    rows = [(1, "u", None, 5), (2, None, "", 6), (3, "v", "<p>" * 600 + "One sentence of content, long enough to be read." + "</div>", 7), (3, "v", "<p>x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("clash"))
    m = html_text.train(html_text.labelled_pages(60))
    got = html_text.extract_pages(pages, m).orderBy("page_id").collect()
    assert len(got) == 4 and [(r.text, r.n_chars) for r in got[:2]] == [("", 0)] * 2 and all(len(r.text) == r.n_chars for r in got)
    assert html_text.extract_pages(pages.where("false"), m).count() == 0


def test_pipeline_removes_copies_and_benchmark_passages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    item, copy = " ".join(text().split()[:20]), text()
    docs = [(i, text(), "s") for i in range(10)] + [(10, copy, "s"), (11, copy, "s"), (12, f"{item} {text()}", "s")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Without labels all are kept; one source is mixed at its own size, each document once.
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(11))


@pytest.mark.parametrize("bucket", [1024, 8])
def test_near_duplicates_stage_removes_edited_copies(spark, monkeypatch, bucket):
    import corpus_pipeline

    monkeypatch.setattr(minhash, "BUCKET", bucket)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs = [(0, "", "s"), (1, None, "s"), (2, "two words", "s"), (3, "Two  words", "s")]
    for g in range(8):
        base = [word() for _ in range(100)]
        for n in range(40 if g == 0 else 6):  # some edits of edits
            w = list(base)
            for at in r.sample(range(5, 95), n % 5):
                w[at] = word()
            docs.append((len(docs), " ".join(w), "s"))
            base = w if n % 3 == 2 else base
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t, _ in docs)]
    label = list(range(len(docs)))
    near = [[j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)] for a in sets]
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    got = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "").select("doc_id").collect()
    assert len(set(label)) < len(docs) - 40 and sorted(x.doc_id for x in got) == sorted(set(label))


def test_near_duplicates_stage_takes_links_of_both_kinds(spark):
    import corpus_pipeline

    # The repeats of a phrase outweigh a few other words in the fingerprint, but count once among the shingles.
    words = [f"w{i}" for i in range(20)]
    a, b = (" ".join(words * 30 + [f"{x}{i}" for i in range(8)]) for x in "ab")
    c = " ".join(f"c{i}" for i in range(100))
    d = " ".join(f"c{i}" if i != 50 else "other" for i in range(100))
    sets = [set(minhash.shingles(x.encode()).tolist()) for x in (a, b)]
    assert simhash.fingerprint(a.encode()) != simhash.fingerprint(d.encode()) and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") <= simhash.TAU
    assert bin(simhash.fingerprint(c.encode()) ^ simhash.fingerprint(d.encode())).count("1") > simhash.TAU
    docs = frame(spark, [(0, a, "s"), (1, b, "s"), (2, c, "s"), (3, d, "s"), (4, c, "s"), (5, "", "s"), (6, None, "s")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()) == [0, 2, 5]
    assert sorted(r.doc_id for r in minhash.similar_dedup(docs).select("doc_id").collect()) == [0, 1, 2, 5]


def test_html_parsing_is_linear_and_knows_any_depth():
    import time

    m = html_text.train(html_text.labelled_pages())
    page = "<article><p>This is the article text, quite long enough to be read as such, with a full stop.</p></article><aside class='sidebar'><p>Aside here.</p></aside>"
    assert m.extract("<div>" * 5000 + page + "</div>" * 5000) == m.extract(page) == ["This is the article text, quite long enough to be read as such, with a full stop."]
    for unit in ("<![CDATA[", '<b ">" ', "<a '><p ", "<button>", "<a ", "<!x ", "</section><div>", "<section><table><div></section>"):
        t = time.time()
        html_text.parse(unit * (400_000 // len(unit)) + "'>")
        assert time.time() - t < 20, unit
    assert [n.text for n in html_text.parse('<a title="x>y" href=\'>\'>b</a><!-- <p> --> c <![CDATA[d]]> e < f <b "> g') if n.text] == ['b c e < f g']


def test_extraction_on_pages_it_was_not_trained_on():
    m, good, bad, miss = html_text.train(html_text.labelled_pages()), 0, 0, 0
    for html, want in html_text.labelled_pages(150, seed=99):
        got = m.extract(html)
        good += sum(len(t) for t in got if t in want)
        bad += sum(len(t) for t in got if t not in want)
        miss += sum(len(t) for t in want if t not in got)
    assert good / (good + bad) > 0.93 and good / (good + miss) > 0.93


def test_proximity_matches_against_plain_spans(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(14)] + ["the"] * 4
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 4, 6, 9]))) for i in range(8)] + [(8, "absent words here"), (9, None), (None, "the")]
    docs = [(i, r.choice(["", ". "]) + text(r.randint(0, 60)), "s") for i in range(25)] + [(3, "the", "s"), (None, "the w1", "s"), (30, None, "s")]
    docs = frame(spark, docs).withColumn("k1", F.lit(1)).withColumn("term", F.lit(2))
    got = sorted(map(tuple, decontaminate.proximity_matches(docs, spark.createDataFrame(items, "item_id long, text string"), span=9, width=5).collect()), key=str)
    want = []
    for row in docs.collect():
        w = (row.text or "").replace(".", " ").split()
        for k, q in items:
            q = (q or "").split() if k is not None else []
            for s in range(max(1, len(q) - 4) if q else 0):
                terms = set(q[s : s + 5])
                at = [p for p in range(len(w)) if w[p] in terms and terms <= set(w[p : p + 9])]
                if at:
                    want.append((row.doc_id, str(k), s, at[0]))
    assert got == sorted(want, key=str) and len(want) > 20


def test_pseudonyms_of_every_kind_are_permutations_of_their_format():
    p, q = pii.Pseudonyms(b"k1"), pii.Pseudonyms(b"k1", back=True)
    cases = {
        "email": ["jörg@x.org", "_me@x.org", "o'neil@x.org", "иван.Петров@почта.рф", "a" * 70 + "@b.example.com", "x+y%z@a-b.co"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "iso": ["2024-02-29", "0001-01-01", "9999-12-31", "1850-06-30"], "dmy": ["1/2/2020", "12/31/2020", "1/31/2020", "01.02.1820", "28.2.2150", "31/12/1999"],
        "ssn": ["123-45-6789"], "ip": ["54.158.173.199", "0.0.0.0"], "phone": ["+1 (375) 555-4393", "(212) 555-0100", "+49 30 1234 5678"], "card": ["4207051279108084", "4207-0512-7910-8084", "378282246310005"],
    }
    shape = lambda s: re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", s))
    for kind, values in cases.items():
        for v in values:
            (out, found), new = p.text(f"see {v}, twice {v}!"), p.text(v)[0]
            assert [f["kind"] for f in found] == [kind] * 2 and out == f"see {new}, twice {new}!" and q.text(out)[0] == f"see {v}, twice {v}!", v
            assert kind == "ip" or len(new) == len(v) and (kind == "email" or shape(new) == shape(v)) and new != v
            assert pii.Pseudonyms(b"k2").text(v)[0] != new
    for v in ("2020-13-01", "31.02.2020", "4207051279108085", "DE88370400440532013000", "000-12-3456", "1.2.3.256", "a@b", "v1.2.3"):
        assert p.text(v) == (v, [])
    # A permutation: of a small format, every value is met once.
    f, n = pii.Feistel(b"k"), 1000
    assert sorted(f.permute(x, n, b"t") for x in range(n)) == list(range(n))


def test_pseudonymise_takes_its_key_from_the_session(spark):
    docs = frame(spark, [(1, "a.b@x.org", "s"), (1, "a.b@x.org", "s"), (2, None, "s"), (3, "", "s")]).withColumn("pii", F.lit("clash"))
    try:
        spark.conf.set(pii.KEY_SETTING, "secret")
        a = pii.pseudonymise(docs).orderBy("doc_id").collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    b = pii.pseudonymise(docs).orderBy("doc_id").collect()
    assert a[0].text == a[1].text == pii.Pseudonyms(b"secret").text("a.b@x.org")[0] != b[0].text
    assert [(r.text, r.pii) for r in a[2:]] == [(None, []), ("", [])] and pii.pseudonymise(docs.where("false")).count() == 0


def test_quality_posteriors_against_plain_loops(spark):
    r = random.Random(12)
    prose = lambda n: " ".join(r.choice("some plain words of quiet prose about nothing much at all".split()) for _ in range(n)) + "."
    junk = lambda n: " ".join(r.choice(["BUY!!", "NOW$$", "###", "WIN!!"]) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        site = r.choice(["a", "b", "c", "d", None])
        bad = r.random() < {"a": 0.1, "b": 0.6, "c": 0.2, "d": 0.9, None: 0.3}[site]
        rows.append((i, junk(r.randint(3, 40)) if bad else prose(r.randint(3, 60)), site))
        if i % 3 == 0:
            labels.append((i, int(not bad) if r.random() < 0.9 else int(bad), 0))
    rows += [(0, rows[0][1], rows[0][2]), (None, "no id", "a"), (500, None, "lonely"), (501, "", None)]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x")).withColumn("s", F.lit(1)).withColumn("site_s", F.lit(2)).withColumn("quality", F.lit(3))
    labels = spark.createDataFrame([*labels, (3, 0, None), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and got[0].s == 1 and got[0].site_s == 2 and got[0].quality == 3
    given = {}
    for x in labels.collect():
        if x.doc_id is not None and x.quality is not None:
            given[x.doc_id] = min(x.quality, given.get(x.doc_id, 1))
    own = [float(given[x.doc_id]) if x.doc_id in given else x.p_document for x in got]
    mean = lambda v: sum(v) / len(v)
    mu = round(mean(own), 9)

    def pooled(groups, means):
        n = sum(map(len, groups))
        var = sum(len(g) * (mean(g) - m) ** 2 for g, m in zip(groups, means)) / n
        unit = sum(len(g) * m * (1 - m) for g, m in zip(groups, means)) / n
        excess = var - unit * len(groups) / n
        return max(unit / excess - 1, 0.0) if excess > 0 else quality.POOLED

    host = {h: [o for o, x in zip(own, got) if x.source == h] for h in {x.source for x in got}}
    m1 = pooled(list(host.values()), [mu] * len(host))
    rate = {h: (sum(v) + m1 * mu) / (len(v) + m1) for h, v in host.items()}
    path = {k: [o for o, x in zip(own, got) if (x.source, x.lang) == k] for k in {(x.source, x.lang) for x in got}}
    m2 = pooled(list(path.values()), [rate[h] for h, _ in path])
    odds = lambda p: np.log(p / (1 - p))
    for o, x in zip(own, got):
        h = host[x.source]
        hr = (sum(h) - o + m1 * mu) / (len(h) - 1 + m1)
        p = path[x.source, x.lang]
        pr = (sum(p) - o + m2 * hr) / (len(p) - 1 + m2)
        assert x.host_rate == pytest.approx(hr, abs=2e-6) and x.path_rate == pytest.approx(pr, abs=1e-4)
        moved = odds(x.p_document) - odds(mu) + odds(min(max(x.path_rate, 0.001), 0.999))
        assert x.p_quality == pytest.approx(1 / (1 + np.exp(-moved)), abs=1e-6) and x.keep == (x.p_quality >= 0.5 and x.p_toxic < 0.5)
    assert {k: v for k, v in rate.items() if k == "d"}["d"] < rate["a"]
    once = quality.classify(docs, labels, keep=["doc_id"]).collect()
    assert sorted((str(x.doc_id), round(x.p_quality, 9)) for x in once) == sorted((str(x.doc_id), round(x.p_quality, 9)) for x in got)


def test_quality_on_labels_it_was_not_fitted_on(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        bad, rude = i % 5 == 0, i % 7 == 0
        w = [r.choice("the quick brown fox jumps over a lazy dog by the river".split()) for _ in range(r.randint(20, 60))]
        if rude:
            w[r.randrange(len(w))] = r.choice(["blorf", "grukk"])
        docs.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), f"s{i % 3}"))
        labels.append((i, int(not bad), int(rude)))
    fit = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify(frame(spark, docs), fit).collect()}
    assert all((got[i].p_quality >= 0.5) == bool(q) and (got[i].p_toxic >= 0.5) == bool(t) for i, q, t in labels if i % 2 == 0)
    # Many rows of a labelled id: one of them is in the sample.
    assert quality.classify(frame(spark, docs + docs[:1] * 50), fit, n=10).count() == 450


def test_language_states_run_through_whole_texts():
    m, r = langid.new_model(["a", "b", "c"], 5), np.random.default_rng(3)
    m.u *= 2
    m.bn += r.standard_normal(m.bn.shape).astype(np.float32)
    texts = [bytes(r.integers(0, 256, n, np.uint8)) for n in (0, 1, 7, 8, 9, 16, 17, 100, 333, 31)]
    soft = lambda x: x / (1 + np.abs(x))
    gate = lambda x: soft(x) / 2 + 0.5

    def states(k, t):  # one byte at a time from the zero state
        h, out = np.zeros(5), []
        for c in t:
            c = langid.FOLD[c]
            z, q = gate(m.e[0, k, c] + h @ m.u[0, k]), h @ m.u[2, k] + m.bn[k]
            new = soft(m.e[2, k, c] + gate(m.e[1, k, c] + h @ m.u[1, k]) * q)
            h = new + z * (h - new)
            out.append(h)
        return out

    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    for chunk, ahead in ((8, 2), (8, 8), (64, 1)):
        got = langid.pooled(m, data, np.cumsum(sizes) - sizes, sizes, chunk, 3, ahead)
        for t, p in zip(texts, got):
            both = [np.r_[a, b] @ m.v + m.c for a, b in zip(states(0, t), states(1, t[::-1])[::-1])]
            want = np.mean([np.exp(x) / np.exp(x).sum() for x in both], 0) if both else np.zeros(3)
            assert np.allclose(p, want, atol=2e-4)
    # The training pass over one row is the same network.
    x = np.frombuffer(texts[7], np.uint8)[None].astype(np.int64)
    loss = langid.loss_and_gradients(m, x, np.array([1]), np.ones(x.shape, bool))[0]
    want = -np.mean([np.log(np.exp(z) / np.exp(z).sum())[1] for z in [np.r_[a, b] @ m.v + m.c for a, b in zip(states(0, texts[7]), states(1, texts[7][::-1])[::-1])]])
    assert abs(loss - want) < 1e-3


def test_language_of_held_out_documents(spark):
    r = random.Random(5)
    say = lambda a: " ".join("".join(r.choice(a) for _ in range(4)) for _ in range(r.randint(3, 300)))
    rows = [(i, say("abcdé" if i % 2 else "fghiö"), "xy"[i % 2], "s", 0) for i in range(300)]
    rows += [(300, None, "x", "s", 0), (301, "", "y", "s", 0), (302, "12 34!", "x", "s", 0), (None, say("abcdé"), "z", "s", 0), (303, say("abcdé"), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    m = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out(), n_docs=120, epochs=6)
    assert m.langs == ["x", "y"]
    got = langid.identify(docs.withColumn("held_out", langid.held_out()), m).collect()
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert len(held) > 50 and all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in held)
    assert [(x.lang_pred, x.score) for x in got if x.doc_id in (300, 301, 302)] == [("und", 0.0)] * 3
    assert [x.lang_pred for x in got if x.doc_id in (None, 303)] == ["y", "y"]
    assert langid.fit(docs.where("false"), F.lit(True)).langs == []


def test_lookup_table_against_a_plain_fill():
    for n, size in ((1, 3), (3, 11), (7, 101), (64, 1009)):
        names, order, table = sharding.shard_names(n), [], {}
        for name in names:
            h = hashlib.sha256(name.encode()).digest()
            offset, skip = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1
            order.append([(offset + j * skip) % size for j in range(size)])
            assert sorted(order[-1]) == list(range(size))
        while len(table) < size:
            for i in range(n):  # turn by turn, the first slot of its order that is free
                free = next((s for s in order[i] if s not in table), None)
                if free is not None:
                    table[free] = i
        assert sharding.lookup_table(names, size) == [table[s] for s in range(size)]


def test_shards_are_written_whole(spark, tmp_path):
    docs = frame(spark, [(1, "a", "s"), (1, "a", "s"), (None, "x", None), (None, None, "s"), (2, "", "s")])
    sharding.write_shards(docs, str(tmp_path / "w"), 4, 2)
    got = spark.read.parquet(str(tmp_path / "w"))
    want = sharding.assign_shards(docs, 4).drop("slot")
    key = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert key(got) == key(want) and len(key(got)) == 5
    sharding.write_shards(docs.where("false"), str(tmp_path / "e"), 4)


def test_fingerprints_against_plain_counts(spark, monkeypatch):
    import xxhash

    r = random.Random(8)
    texts = ["", "  ", "One", "one two", "One TWO three", " a b a b a b a b ", "ÀB àb\x0b\x1cc", None] + [" ".join(r.choice(["x", "Yy", "é"]) for _ in range(r.randint(1, 60))) for _ in range(20)]

    def plain(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for block in (1 << 16, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [plain(t) for t in texts]
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_groups(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(texts)}


def test_pipeline_of_empty_and_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "the cat sat on a mat with the dog", "a"), (1, "the cat sat on a mat with the dog", "a"), (2, None, None), (None, "", "a"), (None, "five words stand here alone", None), (4, "x" * 50_000, "b")]
    items = spark.createDataFrame([(1, None), (None, "the cat")], "item_id long, text string")
    for name, docs, want in (("none", [], []), ("odd", rows, ["1", "2", "4", "None"])):
        frame(spark, docs).withColumn("key_id", F.lit("clash")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key_id", "slot", "shard"]
        # A source of two words with a weight of 5 may be taken three times, one of few words with a weight of 1 not at all.
        found = got.collect()
        assert set(str(r.doc_id) for r in found) <= set(want) and max([0, *(sum(r.doc_id == x.doc_id and r.text == x.text for x in found) for r in found)]) <= 3 and bool(found) == bool(want)
