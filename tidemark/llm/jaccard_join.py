"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles. Tokens are put into classes by the number of
documents that have them: unshared (one), rare, and frequent; the order of tokens is by class, then
by hash. A document of n tokens may miss t = n - ceil(threshold * n) of them in a partner. Its prefix
is extended until more than t tokens would have to miss to spoil every signature: an unshared or rare
token counts one; frequent tokens are dealt into subclasses by hash, and a subclass of c tokens
counts c - 1, as its signatures are pairs of tokens. Rare tokens are indexed singly, frequent ones by
pairs in a subclass. Linked documents then share a signature. Documents with more than t unshared
tokens have no partner and index nothing, which is most of a corpus.

How many subclasses there are depends on the documents' size (a power of two of tokens), so a
subclass of a prefix stays at about five tokens; documents also index the next smaller size if a
partner may have it.

Exact copies of a text count as one document throughout. The documents that share a signature are
compared with one centre first, the one with the fewest unshared tokens; links so far are joined to
components; and only for signatures whose documents lie in different components yet are the documents outside
the largest of them compared with the others, where sizes, shared tokens and a 1024-bit parity of the
tokens (its differences are tokens that one of the two lacks) leave a link possible. So a group of n
near copies costs about n comparisons, and no link between two components is missed. Before that, a
signature of frequent tokens lets go of the documents whose frequent tokens alone can't carry a link
(two that also share a rare token meet by that token): pages of one template with texts of their own
make no pairs. All of that is joins and partial aggregates that split by key; components are found in
steps (see components.py). Texts that 1/10,000 of the rows or more share are looked up by broadcast,
so no task gets a group of copies.

Token classes come from packed sorted key lists per group of documents, as in substring_dedup.py:
about 3.5 bytes a token; answers are two bits a token.

Tokens are compared by 48 bits of their hashes in the final check of two documents, under a key drawn
for each run; copies by 128 bits of SHA-256.

A very long text is hashed and indexed whole by one worker. Ties (a share of exactly the threshold) link.
An empty table gives an empty result.

Defined results: null texts and texts without words have no tokens, link with nothing and are their
own component. With fewer words than a shingle, the whole sequence is the one token. A null id is
its own (null) component. Rows that share an id are one node. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import looked_up, stored, volume
from tidemark.llm.textbytes import PLAIN, Batch, Layout, group_starts, mix, new_key, slices, whole_windows, windows

LISTS = "k int, g int, data binary, more binary"
_LISTS_ARROW = pa.schema([("k", pa.int32()), ("g", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
CONTROL = "g int, k int, data binary, copy long, copy_text long"
_CONTROL_ARROW = pa.schema([("g", pa.int32()), ("k", pa.int32()), ("data", pa.binary()), ("copy", pa.int64()), ("copy_text", pa.int64())])
PROFILES = "id long, n long, shared long, frequent long, tokens binary, signatures array<long>, parity array<long>"
_PROFILES_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("frequent", pa.int64()), ("tokens", pa.binary()), ("signatures", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
UNSHARED, RARE, FREQUENT = 0, 1, 2
TOKEN_BYTES = 6
#: Bits of the parity of the tokens that fall on each bit.
PARITY = 1024


def shingles(b: Batch, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle, with repeats."""
    at, w = whole_windows(b, width, h)
    docs, found = [b.doc[at]], [w]
    for n in range(1, width):  # shorter documents: the whole sequence
        short = np.flatnonzero(b.counts == n)
        if len(short):
            docs.append(short)
            found.append(mix(windows(h, n)[b.first[short]] ^ np.uint64(n)))
    return np.concatenate(docs), np.concatenate(found)


def signatures(tokens: np.ndarray, frequent: np.ndarray, unshared: int, percent: int) -> np.ndarray:
    """tokens: the shared ones, rare before frequent, each by hash. The signatures that are pairs of frequent tokens are odd, all others even."""
    n = unshared + len(tokens)
    misses = n + (-percent * n // 100)
    out = [np.bitwise_xor.reduce(mix(tokens)) ^ np.uint64(n)]  # of equal sets
    single = tokens[~frequent][: max(0, misses + 1 - unshared)]
    out += [mix(single ^ np.uint64(0xA5A5))] if len(single) else []
    short, pairs = misses + 1 - unshared - len(single), []
    if short > 0:
        rest = tokens[frequent]
        band = n.bit_length() - 1
        for level in [band] + ([band - 1] if band and percent * n < 100 * 2**band else []):
            classes = max(1, 2**level // 16)
            own = (mix(rest) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            starts = group_starts(own[order])
            first = np.zeros(len(rest), bool)
            first[order[starts]] = True  # a subclass's first token spoils nothing by itself
            reached = np.flatnonzero(np.cumsum(~first) >= short)
            prefix, of = rest[: reached[0] + 1] if len(reached) else rest, own[: reached[0] + 1] if len(reached) else own
            order = np.argsort(of, kind="stable")
            prefix, of = prefix[order], of[order]
            for a, z in zip(s := group_starts(of), np.append(s[1:], len(of))):
                i, j = np.triu_indices(z - a, 1)
                if len(i):
                    pairs.append(mix(prefix[a:z][i] * np.uint64(3) + mix(prefix[a:z][j] + np.uint64(level + 1))))
    other = np.concatenate([np.atleast_1d(x) for x in out]) & ~np.uint64(1)
    return np.unique(np.concatenate([other, *[x | np.uint64(1) for x in pairs]]))


class Join:
    def __init__(self, width: int, percent: int, rare: int, words: int, groups: int):
        self.width, self.percent, self.rare, self.key = width, percent, rare, new_key()
        self.layout = Layout(words, groups, 3 if words < 2**34 else 4)

    def _tokens(self, t: pa.Table, skip: np.ndarray):
        """Distinct (row, hash), by hash; rows of copies left out if skip."""
        rows, found = [], []
        for a, z in slices(t["text"]):
            b = Batch(t["text"].slice(a, z - a), PLAIN, lower=True)
            docs, h = shingles(b, b.hashes(self.key), self.width)
            keep = ~skip[a + docs]
            rows.append(a + docs[keep])
            found.append(h[keep])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((rows, found))
        rows, found = rows[order], found[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        return rows[new], found[new]

    @staticmethod
    def _copies(t: pa.Table, control: pa.Table) -> np.ndarray:
        """Rows without an id, and those whose id and text (by its hash) the control table names."""
        copies = {x for x in zip(control["copy"].to_pylist(), control["copy_text"].to_pylist()) if x[0] is not None}
        return np.fromiter((i is None or (i, h) in copies for i, h in zip(t["id"].to_pylist(), t["h"].to_pylist())), bool, t.num_rows)

    def send(self, key, t: pa.Table, control: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _LISTS_ARROW.empty_table()
        g = key[0].as_py()
        _, h = self._tokens(t, self._copies(t, control))
        keys = self.layout.keys(h)
        starts = group_starts(keys)
        counts = np.minimum(np.diff(np.append(starts, len(keys))), 255).astype(np.uint8)
        distinct = keys[starts]
        out = [(k, self.layout.pack(distinct[a:z]), counts[a:z].tobytes()) for k, a, z in self.layout.split(distinct)]
        return pa.table([[x[0] for x in out], [g] * len(out), [x[1] for x in out], [x[2] for x in out]], schema=_LISTS_ARROW)

    def classify(self, key, t: pa.Table) -> pa.Table:
        """Two bits for each key of each list: its class by the documents that have it."""
        k = key[0].as_py()
        lists = [self.layout.unpack(x.as_py(), k) for x in t["data"]]
        keys = np.concatenate(lists)
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["more"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        starts = group_starts(keys[order])
        total = np.add.reduceat(counts[order], starts)
        kind = np.where(total < 2, UNSHARED, np.where(total <= self.rare, RARE, FREQUENT)).astype(np.uint8)
        every = np.empty(len(keys), np.uint8)
        every[order] = np.repeat(kind, np.diff(np.append(starts, len(keys))))
        parts = np.split(every, np.cumsum([len(x) for x in lists])[:-1])
        out = [(g.as_py(), np.packbits(np.stack([c & 1, c >> 1])).tobytes()) for g, c in zip(t["g"], parts) if c.any()]
        return pa.table([[g for g, _ in out], [k] * len(out), [d for _, d in out], pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], schema=_CONTROL_ARROW)

    def profile(self, key, t: pa.Table, control: pa.Table) -> pa.Table:
        """A row for each document; those that may have a partner come with their shared tokens and signatures."""
        if not t.num_rows:
            return _PROFILES_ARROW.empty_table()
        copies = self._copies(t, control)
        n_rows = t.num_rows
        rows, h = self._tokens(t, np.zeros(n_rows, bool))
        n = np.bincount(rows, minlength=n_rows)
        own = ~copies[rows]
        rows, h = rows[own], h[own]
        keys = self.layout.keys(h)
        starts = group_starts(keys)
        distinct = keys[starts]
        kind = np.zeros(len(distinct), np.uint8)
        marks = {k.as_py(): d.as_py() for k, d in zip(control["k"], control["data"]) if d.is_valid}
        for k, a, z in self.layout.split(distinct):
            if k in marks:
                low, high = np.unpackbits(np.frombuffer(marks[k], np.uint8), count=2 * (z - a)).reshape(2, -1)
                kind[a:z] = low + 2 * high
        kind = np.repeat(kind, np.diff(np.append(starts, len(keys))))
        unshared = np.bincount(rows[kind == UNSHARED], minlength=n_rows)
        hopeful = ~copies & (n > 0) & (unshared <= n + (-self.percent * n // 100))
        use = np.flatnonzero(hopeful[rows] & (kind != UNSHARED))
        use = use[np.lexsort((h[use], kind[use], rows[use]))]
        rows, h, kind = rows[use], h[use], kind[use]
        cuts = np.searchsorted(rows, np.arange(n_rows + 1))
        tokens, found, parity = [None] * n_rows, [None] * n_rows, [None] * n_rows
        for r in np.flatnonzero(hopeful):
            own = h[cuts[r] : cuts[r + 1]]
            found[r] = signatures(own, kind[cuts[r] : cuts[r + 1]] == FREQUENT, int(unshared[r]), self.percent).view(np.int64)
            tokens[r] = np.sort(own >> np.uint64(64 - 8 * TOKEN_BYTES)).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()
            parity[r] = np.packbits(np.bincount(((own >> np.uint64(16)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view(np.int64)
        return pa.table([t["id"], n, n - unshared, np.bincount(rows[kind == FREQUENT], minlength=n_rows), tokens, found, parity], schema=_PROFILES_ARROW)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :TOKEN_BYTES] = raw
    return full.view(np.uint64)[:, 0]


def verified(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ids whose shared tokens reach the threshold."""
    side = profiles.where("tokens IS NOT NULL").select("id", "n", "tokens")

    def check(batches):
        for batch in batches:
            u, v, n_u, n_v, t_u, t_v = batch.columns
            n_u, n_v = n_u.to_numpy(), n_v.to_numpy()
            last, last_tokens, ok = None, None, np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = t_u[i].as_py()
                if a != last:
                    last, last_tokens = a, _unpack(a)
                both = np.concatenate([last_tokens, _unpack(t_v[i].as_py())])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (n_u[i] + n_v[i] - common)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], names=["u", "v"])

    first = pairs.join(side.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("tokens").alias("t_u")), "u")
    both = first.join(side.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("tokens").alias("t_v")), "v")
    return both.select("u", "v", "n_u", "n_v", "t_u", "t_v").mapInArrow(check, "u long, v long")


def _possible(percent: int):
    """Whether sizes, shared tokens and their parities leave a link possible: intersection >= p / (100 + p) of the sizes' sum. Bits in which the parities differ are tokens that only one of the two has."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("a.parity")[i].bitwiseXOR(F.col("b.parity")[i])) for i in range(PARITY // 64)])
    most = F.least(F.col("a.usable"), F.col("b.usable"), F.floor((F.col("a.shared") + F.col("b.shared") - apart) / 2))
    return (100 + percent) * most >= percent * (F.col("a.n") + F.col("b.n"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 75, rare: int = 8, group_bytes: int = 4 << 20) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    size = volume(docs, text_col)
    group_bytes = max(group_bytes, min(32 << 20, size.bytes // 50_000))
    groups = max(1, -(-size.bytes // group_bytes), -(-size.rows // 100_000))
    run = Join(width, percent, rare, max(1, size.bytes // 5), groups)
    group_of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int")  # noqa: E731  of id and text, so no id's rows meet
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    dealt = plain.withColumn("h", F.xxhash64("text")).withColumn("g", group_of("id", "h"))

    # exact copies: each names the smallest id with its text
    named = plain.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("same"), F.xxhash64("text").alias("h"))
    least = stored(named.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    hot = least.where(F.col("many") >= max(1000, size.rows // 10_000))  # 10,000 texts at most
    copies = stored(looked_up(named, least, "same", "rep", hot, F.unhex(F.hex("id"))).where("id > rep").select("id", "rep", "h").distinct())
    rep_of = copies.groupBy("id").agg(F.min("rep").alias("rep"))
    several = plain.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id")  # rows that share an id are one node

    control = copies.select(group_of("id", "h").alias("g"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("data"), F.col("id").alias("copy"), F.col("h").alias("copy_text"))
    lists = dealt.groupBy("g").cogroup(control.groupBy("g")).applyInArrow(lambda key, t, c: run.send(key, t, c), LISTS)
    classes = lists.groupBy("k").applyInArrow(lambda key, t: run.classify(key, t), CONTROL)
    profiles = stored(dealt.groupBy("g").cogroup(control.unionByName(classes).groupBy("g")).applyInArrow(lambda key, t, c: run.profile(key, t, c), PROFILES))

    # usable: how many tokens a link found by this signature can share; one with another rare token in common has a signature of that token
    indexed = profiles.where("signatures IS NOT NULL").select("id", "n", "shared", "frequent", F.explode("signatures").alias("sig"))
    indexed = indexed.select("sig", "id", "n", F.when(F.col("sig").bitwiseAND(1) == 1, F.col("frequent")).otherwise(F.col("shared")).alias("usable"))
    stats = indexed.groupBy("sig").agg(F.min(F.struct((F.col("n") - F.col("usable")).alias("other"), F.col("id"), F.col("n"), F.col("usable"))).alias("c"), F.count(F.lit(1)).alias("many")).where("many > 1")
    hopeful = (100 - percent) * F.col("usable") >= percent * (F.col("n") - F.col("usable") + F.col("c.other"))  # with the partner that has the fewest other tokens
    shared = stored(indexed.join(stored(stats), "sig").where(hopeful).select("sig", "id", "n", "usable", "many", F.col("c.id").alias("c_id"), F.col("c.n").alias("c_n"), F.col("c.usable").alias("c_usable")))
    stars = shared.where("id <> c_id").where((100 + percent) * F.least("usable", "c_usable") >= percent * (F.col("n") + F.col("c_n")))
    links = stored(verified(stars.select(F.col("c_id").alias("u"), F.col("id").alias("v")).distinct(), profiles, percent))
    labels = components(links)

    # signatures whose documents aren't in one component yet: those outside the signature's largest component against all
    marked = shared.where("many > 2").select("sig", "id", "n", "usable", "c_id").join(labels, "id", "left").withColumn("label", F.coalesce("component_id", "id"))
    split = marked.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
    open_ = marked.join(split, "sig").where("id <> c_id")
    main = open_.groupBy("sig", "label").count().groupBy("sig").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    parities = profiles.where("parity IS NOT NULL").select("id", "shared", "parity")
    members = stored(open_.join(main, "sig").join(parities, "id").select("sig", "id", "n", "usable", "shared", "label", "main", "parity"))
    minor = members.where("label <> main").alias("a")
    across = minor.join(members.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))) & _possible(percent))
    across = across.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()
    more = stored(verified(across, profiles, percent))
    joined = components(labels.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionAll(more.select("u", "v")).unionAll(copies.join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))))

    out = profiles.select("id", F.col("n").alias("n_shingles")).join(rep_of, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = looked_up(out, joined.select(F.col("id").alias("rep"), "component_id"), "rep", "component_id", hot.select("rep").distinct(), F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
