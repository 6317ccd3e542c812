import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from granary.llm import registry
from tests.compare import assert_same, connect

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def test_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in registry.oracle_sql().items():
        assert_same(registry.queries()[name](spark, sf_dir), con, sql)


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WHITE.split(text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_of_components(texts):
    sets, up = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {find(i) for i in texts}


def test_stages_by_brute_force(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in registry.op6_toxicity(spark, sf_dir).collect() if r.score >= 0.3}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), "test")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        assert docs.columns[: len(columns)] == columns
        assert {tuple(r[: len(columns)]) for r in after} <= {tuple(r) for r in before}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            assert Counter(ids) == Counter(set(texts) - toxic) and toxic
        elif name == "exact_dedup":
            first = defaultdict(list)
            for i, t in texts.items():
                first[WHITE.sub(" ", t or "")].append(i)
            assert Counter(ids) == Counter(min(g) for g in first.values())
        elif name == "ngram_jaccard_join":
            assert Counter(ids) == Counter(least_of_components(texts))
        elif name == "mixing":
            size = {i: len([x for x in WHITE.split(t or "") if x]) for i, t in texts.items()}
            source = {r.doc_id: r.source for r in before}
            total, taken = defaultdict(int), defaultdict(int)
            for i in texts:
                total[source[i]] += size[i]
            for i in ids:
                taken[source[i]] += size[i]
            assert max(Counter(ids).values()) <= 3
            order = sorted(total, key=lambda s: (s is None, s or ""))
            weight = {s: 1 + k % 3 for k, s in enumerate(order)}
            target, left, open_ = {}, float(sum(total.values())), set(order)
            while open_:
                share = left / sum(weight[s] for s in open_)
                full = [s for s in open_ if share * weight[s] > 3 * total[s]]
                for s in full or list(open_):
                    target[s] = 3.0 * total[s] if full else share * weight[s]
                    open_.discard(s)
                    left -= target[s]
            for s in order:
                assert abs(taken[s] - target[s]) <= max(size[i] for i in texts if source[i] == s)
        else:
            assert Counter(ids) == Counter(r.doc_id for r in before)
            for r in after:
                wanted = sp.encode(r.text or "", add_bos=True, add_eos=True)
                assert (r.n_tokens, bytes(r.ids)) == (len(wanted), b"".join(i.to_bytes(4, "little") for i in wanted))
                assert r.decoded_sha256 == hashlib.sha256(sp.decode(wanted).encode()).hexdigest()
