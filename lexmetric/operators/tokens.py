"""Token and array operators.

Token sequences are ``ARRAY`` columns; padding is an operator, not a storage
rule.  Lookups against the vocabulary deal the samples to chunks, join only
the distinct tokens of each chunk with the vocabulary, and put the answers in
the tokens' places chunk by chunk, so what moves are the samples and a small
dictionary of each chunk, never a row per token.  (A map value in a
``transform`` looks keys up linearly in Spark, so it is no substitute for the
join beyond toy vocabularies.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmetric.functions.columns import strip_text, words
from lexmetric.operators.sequence import with_position
from lexmetric.operators.sizing import DEFAULT_MAX_BYTES, broadcast_if_small

# The special symbols and their ids, first in every vocabulary
# (beginning of sentence, padding, end of sentence, unknown).
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")
BOS, PAD, EOS, UNK = 0, 1, 2, 3
UNK_ESCAPED = "<<unk>>"

def tokenize(df: DataFrame, text: str = "text", out: str = "tokens",
             max_len: int | None = None) -> DataFrame:
    """Text -> whitespace tokens, truncated to ``max_len`` when given."""
    toks = words(strip_text(text))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    return df.withColumn(out, toks)


def build_vocab(df: DataFrame, tokens: str = "tokens", specials: Sequence[str] = SPECIALS,
                extra_specials: Sequence[str] = (), min_count: int = 1) -> DataFrame:
    """``(token_id, token, n, is_special)``; specials first, then tokens by
    count descending and token ascending.  Ranking uses D4 positions."""
    spark = df.sparkSession
    all_specials = list(specials) + [s for s in extra_specials if s not in specials]
    counted = (
        df.select(F.explode(tokens).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= min_count) & ~F.col("token").isin(all_specials))
    )
    ranked = with_position(counted, [F.desc("n"), F.asc("token")], name="_rank")
    body = ranked.select(
        (F.col("_rank") + F.lit(len(all_specials))).cast("int").alias("token_id"),
        "token", F.col("n").cast("long").alias("n"), F.lit(False).alias("is_special"))
    head = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("token_id"), F.lit(s).alias("token"),
                 F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_special"))
        for i, s in enumerate(all_specials)])))
    return head.unionByName(body)


def _by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their (unique) key before an explode: the regrouping that
    follows a broadcast lookup then finds its partitioning and moves no token."""
    return df.repartition(F.col(key))


#: Chunks of samples at least (else one per shuffle partition): a chunk is what one call on Arrow data holds.
CHUNKS = 256


def _chunk(df: DataFrame, key: str) -> Column:
    """The chunk of a sample: by its key, so equal (and null) keys meet in one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(F.col(key)), F.lit(max(CHUNKS, parts))).cast("int")


def _dealt(df: DataFrame, cols: Sequence[str], values: Column, key: str) -> DataFrame:
    """(cols, _v, _c): the array ``values`` and its row's chunk.  Texts travel joined (``_t``), with
    their lengths in ``_v``: an array of texts takes four times the room."""
    rows = df.select(*cols, values.alias("_v"), _chunk(df, key).alias("_c"))
    if not isinstance(rows.schema["_v"].dataType.elementType, T.StringType):
        return rows
    return rows.withColumn("_t", F.array_join("_v", "")).withColumn("_v", F.transform("_v", lambda x: F.octet_length(x)))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values (nulls too) get equal numbers."""
    if pa.types.is_struct(column.type):
        codes = pc.is_null(column).to_numpy(zero_copy_only=False).astype(np.int64)
        for field in column.flatten():
            codes = np.unique(codes * (len(column) + 1) + _codes(field), return_inverse=True)[1]
        return codes
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _flat_items(part: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(items of all rows, items of each row): texts from their joined text and byte lengths."""
    lists = _one(part.column("_v"))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    if "_t" not in part.column_names:
        return flat, size
    joined = pc.fill_null(_one(part.column("_t")).cast(pa.string()), "")
    _, offsets, data = joined.buffers()
    begin = int(np.frombuffer(offsets, dtype=np.int32)[joined.offset]) if len(joined) else 0
    ends = begin + np.concatenate([[0], np.cumsum(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False))])
    texts = pa.Array.from_buffers(pa.string(), len(flat), [None, pa.py_buffer(ends.astype(np.int32)), data])
    return (pc.if_else(flat.is_valid(), texts, None) if flat.null_count else texts), size


def _looked_up(df: DataFrame, values: Column, key: str, carry: Sequence[str] | None, out: str,
               table: DataFrame, on: str, found: Column, max_bytes: int, default=None) -> DataFrame:
    """``out``: of every item of the array ``values`` what ``found`` gives for its row of ``table``
    (unique in ``on``; no row, or a null item: ``default``).

    Rows of one key become one row with ``carry`` (small columns); its items are then in order of
    position and answer.  Without ``carry`` every row of ``df`` stays, with the answer of its key
    (a null key: none).  The rows are dealt to chunks by key; the distinct items of each chunk
    alone meet the table, and their answers come back to the chunk.
    """
    attach = carry is None
    cols = [key, *([c for c in df.columns if c != key] if attach else carry)]
    rows = _dealt(df, cols, values, key)
    item = df.select(values.alias("_v")).schema["_v"].dataType.elementType

    def distinct(part: pa.Table) -> pa.Table:
        items = _flat_items(part)[0].unique().drop_null()
        return pa.table({"_k": pa.repeat(part.column("_c")[0], len(items)), "_item": items})

    # Both uses take whole rows by the same key, so Spark shuffles them once.
    items = rows.groupBy("_c").applyInArrow(distinct, T.StructType([
        T.StructField("_k", T.IntegerType()), T.StructField("_item", item)]))
    answers = (items.withColumnRenamed("_item", on).join(broadcast_if_small(table, max_bytes), on, "left")
               .select("_k", F.col(on).alias("_item"), found.alias("_found")))
    schema = T.StructType([df.schema[c] for c in cols] + [
        T.StructField(out, T.ArrayType(answers.schema["_found"].dataType))])

    def answer(part: pa.Table, known: pa.Table) -> pa.Table:
        flat, size = _flat_items(part)
        got = _one(known.column("_found")).take(
            pc.index_in(flat, value_set=_one(known.column("_item")), skip_nulls=True))
        if default is not None:
            got = pc.fill_null(got, default)
        ids = _one(part.column(key))
        codes = _codes(ids)
        first = group = np.arange(len(size))
        if len(np.unique(codes)) < len(size):       # repeated keys: one list of them all
            _, first, group = np.unique(codes, return_index=True, return_inverse=True)
            place = np.arange(len(got)) - np.repeat(np.cumsum(size) - size, size)
            order = pc.sort_indices(pa.table({"g": np.repeat(group, size), "p": place, "v": got}), sort_keys=[
                ("g", "ascending"), ("p", "ascending"), ("v", "ascending")], null_placement="at_start")
            got, size = got.take(order), np.bincount(group, weights=size, minlength=len(first)).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), got)
        if not attach:
            return part.select(cols).take(pa.array(first)).append_column(out, lists)
        nowhere = pc.is_null(ids).to_numpy(zero_copy_only=False)
        return part.select(cols).append_column(out, lists.take(pa.array(group, mask=nowhere)))

    looked = rows.groupBy("_c").cogroup(answers.groupBy("_k")).applyInArrow(answer, schema)
    return looked if attach else looked.select(key, out, *carry)


def encode(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "ids",
           key: str = "sample_id", unk: int = UNK, keep: Sequence[str] | None = None,
           max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Tokens -> ids; unknown tokens -> ``unk``.  ``key`` must be unique.

    With ``keep`` (small scalar columns) the result is ``key, out, *keep``;
    otherwise every column of ``df`` stays beside ``out``.
    """
    return _looked_up(df, F.col(tokens), key, keep, out, vocab.select("token", "token_id"), "token",
                      F.col("token_id"), max_bytes, default=unk)


def pad(df: DataFrame, tokens: str = "ids", pad_id: int = PAD, length: int | None = None,
        left: bool = False, out: str | None = None) -> DataFrame:
    """C4: pad to the longest row or to a given length.

    The longest row is a scalar subquery (one number); adaptive execution
    shares its exchanges with the main plan instead of computing them twice.
    Padding a whole corpus to its longest row multiplies its size by
    ``longest / mean``; for training batches use ``collate`` (per batch).
    """
    out = out or tokens
    target = F.lit(length) if length is not None else F.coalesce(
        df.agg(F.max(F.size(tokens))).scalar(), F.lit(0))
    fill = F.array_repeat(F.lit(pad_id), F.greatest(target - F.size(tokens), F.lit(0)))
    padded = F.concat(fill, F.col(tokens)) if left else F.concat(F.col(tokens), fill)
    return df.withColumn(out, padded)


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "decoded",
           key: str = "sample_id", skip_specials: bool = True, escape_unk: bool = False,
           eos: int = EOS, unk: int = UNK, keep: Sequence[str] | None = None,
           max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Ids -> space-joined text.

    ``skip_specials`` drops every id the vocabulary marks as special, added
    ones included.  Otherwise specials stay except eos, and with ``escape_unk``
    the unknown id prints as ``<<unk>>``.  An id outside the vocabulary prints
    as the unknown token, so it never makes a wrong sequence look right.
    """
    keep_id = lambda x: F.lit(True) if skip_specials else x != F.lit(eos)

    def render(x, tok):
        unknown = F.lit(UNK_ESCAPED if escape_unk and not skip_specials else SPECIALS[unk])
        shown = F.when(x.isNotNull() & tok.isNull(), unknown).otherwise(tok)
        if skip_specials:
            return F.when(~F.coalesce(F.col("is_special"), F.lit(False)), shown)
        if escape_unk:
            return F.when(x == F.lit(unk), unknown).otherwise(shown)
        return shown

    toks = _looked_up(df, F.filter(F.col(ids), keep_id), key, keep, "_toks",
                      vocab.select("token_id", "token", "is_special"), "token_id",
                      render(F.col("token_id"), F.col("token")), max_bytes)
    return toks.withColumn(out, F.array_join("_toks", " ")).drop("_toks")


def collate(df: DataFrame, tokens: str = "ids", batch: str = "batch_id", pad_id: int = PAD,
            eos: int = EOS, left_pad: bool = False, move_eos_to_front: bool = False,
            out: str | None = None) -> DataFrame:
    """Pad every batch to its longest row; optionally rotate a trailing eos
    to the front (the teacher-forcing input).  A batch is bounded by the batch
    size, so the per-batch max is a bounded window."""
    out = out or tokens
    t = F.col(tokens)
    if move_eos_to_front:
        t = F.when(F.try_element_at(t, F.lit(-1)) == F.lit(eos),
                   F.concat(F.array(F.lit(eos)), F.slice(t, 1, F.size(t) - 1))).otherwise(t)
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    fill = F.array_repeat(F.lit(pad_id), longest - F.size(tokens))
    return df.withColumn(out, F.concat(fill, t) if left_pad else F.concat(t, fill))


def unknown_markers(vocab: DataFrame, marker: str = "<unk>") -> DataFrame:
    """Vocabulary entries that contain the unknown marker."""
    return vocab.filter(F.col("token").contains(marker))


def unknown_rate(df: DataFrame, ids: str = "ids", unk: int = UNK, out: str = "unk_rate") -> DataFrame:
    """Share of unknown ids per sample (null for an empty sample)."""
    n = F.size(ids)
    return df.withColumn(out, F.when(n > 0, F.size(F.filter(ids, lambda x: x == F.lit(unk))) / n))


#: Vectors of one Arrow batch of an answer, about.
BATCH_VECTORS = 2 ** 14


def _embedded(rows: DataFrame, by: Sequence[str], vectors: DataFrame, dim: int, scale: float, pad_id: int,
              out: str, max_bytes: int, attach: bool = False) -> DataFrame:
    """``rows`` with, for ``_ids``, the vectors ``out``; rows alike in ``by`` become one, its vectors in
    order of position and vector (``attach``: each stays and has them all; none where ``by[0]`` is null).

    The rows are dealt to chunks.  A chunk's distinct ids alone meet the vectors, and come back to
    the chunk before its rows, so a task holds the vectors of one chunk's ids and one batch of
    answers; no vector is shuffled or sorted per token.
    """
    chunks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int")).repartition(chunks, "_c")
    cols = [c for c in rows.columns if c not in ("_ids", "_c")]
    item = rows.schema["_ids"].dataType.elementType

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_ids")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            pairs = pa.table({"_c": np.repeat(batch.column("_c").to_numpy(), size), "_id": pc.list_flatten(lists)})
            yield from pairs.group_by(["_c", "_id"]).aggregate([]).to_batches()

    # Both uses take whole rows dealt alike, so Spark computes and shuffles them once.
    ids = (rows.mapInArrow(distinct, T.StructType([T.StructField("_c", T.IntegerType()), T.StructField("_id", item)]))
        .where(F.col("_id").isNotNull() & (F.col("_id") != F.lit(pad_id))).distinct())
    scaled = vectors.where(F.col("vec").isNotNull()).select(F.col("token_id").alias("_id"), F.transform(
        "vec", lambda x: x.cast("double") * F.lit(float(scale))).alias("_vec"))
    known = ids.join(broadcast_if_small(scaled, max_bytes), "_id").withColumn("_row", F.lit(False))
    dealt = (rows.withColumn("_row", F.lit(True)).unionByName(known, allowMissingColumns=True)
             .repartition(chunks, "_c").sortWithinPartitions("_c", "_row", *by, "_id", "_vec"))
    schema = T.StructType([rows.schema[c] for c in cols] + [
        T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
    nothing = pa.array([[0.0] * dim], pa.list_(pa.float64()))

    def answer(part: pa.Table, at: np.ndarray, vecs: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows of ``part`` (whole runs of alike rows) with the vectors of their ids."""
        code = _codes_of(part, by)
        run = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        lists = _one(part.column("_ids"))
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        flat = pc.list_flatten(lists)
        ids = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        first = np.searchsorted(at, ids)
        times = np.searchsorted(at, ids, side="right") - first
        times[~flat.is_valid().to_numpy(zero_copy_only=False)] = 0
        first[times == 0] = len(at)                 # pad, null and unknown ids
        times = np.maximum(times, 1)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + BATCH_VECTORS, side="right")))
            hi = int(np.searchsorted(run, run[hi - 1], side="right"))
            begin, end = int(ends[lo] - size[lo]), int(ends[hi - 1])
            n = times[begin:end]
            took = np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            vec = vecs.take(pa.array(took))
            row = np.repeat(np.repeat(np.arange(hi - lo), size[lo:hi]), n)
            some = part.slice(lo, hi - lo).select(cols)
            group = run[lo:hi] - run[lo]
            if group[-1] + 1 < hi - lo:             # alike rows: one list of them all
                place = np.repeat(np.arange(begin, end) - np.repeat(ends[lo:hi] - size[lo:hi], size[lo:hi]), n)
                texts = [[(x is not None, x != x, x) for x in v] for v in vec.to_pylist()]
                order = sorted(range(len(took)), key=lambda i: (group[row[i]], place[i], texts[i]))
                row, vec = group[row][order], vec.take(pa.array(order))
                lists_of = np.bincount(row, minlength=group[-1] + 1)
            else:
                lists_of = np.bincount(row, minlength=hi - lo)
            got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists_of)]).astype(np.int32)), vec)
            if attach:
                got = got.take(pa.array(group, mask=pc.is_null(some.column(by[0])).to_numpy()))
            elif len(got) < len(some):
                some = some.take(pa.array(np.flatnonzero(np.diff(group, prepend=-1))))
            yield from some.append_column(out, got).combine_chunks().to_batches()
            lo = hi

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, vecs, open_run, new = None, [], [], None, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            mark = batch.column("_c").to_numpy().astype(np.int64) * 2 + batch.column("_row").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = table.slice(lo, hi - lo)
                if mark[lo] // 2 != chunk:
                    if open_run is not None:
                        yield from answer(open_run, at, vecs)
                    chunk, at, vecs, open_run, new = mark[lo] // 2, [], [], None, True
                if not mark[lo] % 2:                # the chunk's ids, sorted, before its rows
                    at.append(_one(part.column("_id")).to_numpy())
                    vecs.append(_one(part.column("_vec")))
                    continue
                if new:
                    at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
                    vecs, new = pa.concat_arrays([*[v.cast(nothing.type) for v in vecs], nothing]), False
                part = part.select([*cols, "_ids"])
                if open_run is not None:
                    part = pa.concat_tables([open_run, part]).combine_chunks()
                code = _codes_of(part, by)
                last = int(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[-1])
                if last:
                    yield from answer(part.slice(0, last), at, vecs)
                open_run = part.slice(last)         # its run may go on in the next batch
        if open_run is not None:
            yield from answer(open_run, at, vecs)

    return dealt.mapInArrow(place, schema)


def _codes_of(part: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Rows alike in ``by`` get equal numbers."""
    codes = np.zeros(len(part), dtype=np.int64)
    for c in by:
        codes = np.unique(codes * (len(part) + 1) + _codes(_one(part.column(c))), return_inverse=True)[1]
    return codes


def embed_tokens(df: DataFrame, vectors: DataFrame, ids: str = "ids", key: str = "sample_id",
                 scale: float = 1.0, pad_id: int = PAD, dim: int | None = None,
                 out: str = "vectors", keep: Sequence[str] | None = None,
                 max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Look up a vector per token, scaled by ``scale`` (1 or sqrt(dim));
    pad and ids without a vector give zero vectors."""
    if dim is None:
        dim = vectors.select(F.size("vec")).first()[0]
    cols = [key, *([c for c in df.columns if c != key] if keep is None else keep)]
    return _embedded(df.select(*cols, F.col(ids).alias("_ids")), [key], vectors, dim, scale, pad_id, out,
                     max_bytes, attach=keep is None)


def embed_pieces(df: DataFrame, vectors: DataFrame, ids: str = "ids", key: str = "sample_id",
                 piece: int = 256, scale: float = 1.0, pad_id: int = PAD, dim: int | None = None,
                 out: str = "vectors", max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """C12 in pieces: ``(key, piece, out)``, where piece k holds the vectors of
    positions ``k * piece`` to ``(k + 1) * piece - 1``, so no row grows with a
    sample's length.

    Pieces are dealt to chunks, and a vector moves once per chunk, not once per
    piece.  Pad, null and unknown ids give zero vectors; a sample without ids
    has no piece.  ``key`` must be unique.
    """
    if dim is None:
        dim = vectors.select(F.size("vec")).first()[0]
    starts = F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / piece).cast("int"))
    pieces = df.where(F.size(ids) > 0).select(key, F.posexplode(F.transform(
        starts, lambda k: F.slice(ids, k * piece + 1, piece))).alias("piece", "_ids"))
    return _embedded(pieces, [key, "piece"], vectors, dim, scale, pad_id, out, max_bytes)


def vocab_with_vectors(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach pretrained vectors where the token is known; flag misses."""
    return (vocab.join(vectors.select("token", "vec"), "token", "left")
            .withColumn("has_vector", F.col("vec").isNotNull()))


def _ngrams(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))


def ngrams(df: DataFrame, n: int, tokens: str = "tokens", key: str = "sample_id") -> DataFrame:
    """All n-grams with their 1-based start; rows shorter than n give none."""
    return (_by_key(df.filter(F.size(tokens) >= n), key)
            .select(key, F.posexplode(_ngrams(F.col(tokens), n)).alias("start", "ngram"))
            .withColumn("start", F.col("start") + 1))


def ngram_continuations(df: DataFrame, n: int, tokens: str = "tokens",
                        key: str = "sample_id") -> DataFrame:
    """C14: each (n-1)-gram of a sample with the sorted tokens that followed it.

    The samples are dealt to chunks by key; inside a chunk tokens are numbers,
    and n-grams are told apart by numbers too, so none is shuffled or sorted
    as text."""
    rows = _dealt(df.filter(F.size(tokens) >= n), [key], F.col(tokens), key)
    item = df.schema[tokens].dataType.elementType
    schema = T.StructType([df.schema[key], T.StructField("prefix", T.ArrayType(item)),
                           T.StructField("continuations", T.ArrayType(item))])

    def follow(part: pa.Table) -> pa.Table:
        flat, size = _flat_items(part)
        coded = flat.dictionary_encode(null_encoding="encode")
        words, token = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.sort_indices(words, null_placement="at_end").to_numpy()
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        token, words, ids = rank[token], words.take(pa.array(order)), _one(part.column(key))
        # Every start that has n tokens of its own row, in order.
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        starts = np.flatnonzero(place + n <= np.repeat(size, size))
        row = np.repeat(np.arange(len(size)), size)[starts]
        gram = _codes(ids)[row]
        for k in range(n - 1):
            gram = np.unique(gram * len(words) + token[starts + k], return_inverse=True)[1]
        _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
        pairs = np.unique(gram * len(words) + token[starts + n - 1])
        pairs = pairs[pc.is_valid(words).to_numpy(zero_copy_only=False)[pairs % len(words)]]
        ends = np.cumsum(np.bincount(pairs // len(words), minlength=len(first)))
        prefix = (starts[first][:, None] + np.arange(n - 1)[None, :]).ravel()

        def lists(ends: np.ndarray, picked: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                            words.take(pa.array(picked)))
        return pa.table([ids.take(pa.array(row[first])), lists(np.arange(1, len(first) + 1) * (n - 1), token[prefix]),
                         lists(ends, pairs % len(words))], names=[key, "prefix", "continuations"])

    return rows.groupBy("_c").applyInArrow(follow, schema)


def _with_ngram_hashes(df: DataFrame, n: int, tokens: str, out: str) -> DataFrame:
    """``out``: the hash of the n-gram at every start (rows of ``n`` tokens or more).

    Hashes of 1, 2, 4, ... tokens are combined, each level from the one before,
    so a row holds a few numbers per token whatever ``n`` is and no n-gram is
    cut out of it."""
    def join(a: str, b: str, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, shift + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_level", F.transform(tokens, lambda x: F.xxhash64(x)))
    width, done = 1, 0
    while done < n:
        if n & width:
            df = df.withColumn("_got", join("_got", "_level", done) if done else F.col("_level"))
            done += width
        if done < n:
            df = df.withColumn("_level", join("_level", "_level", width))
        width *= 2
    return df.withColumn(out, F.slice("_got", 1, F.greatest(F.size(tokens) - n + 1, F.lit(0)))).drop("_level", "_got")


def repeated_ngrams(df: DataFrame, n: int, tokens: str = "tokens",
                    key: str = "sample_id") -> DataFrame:
    """C14: n-grams that occur more than once in the same sample.

    Hashes sorted inside the row find the starts that may repeat; only those
    n-grams are cut out, and they are counted by their tokens, so a collision
    of hashes counts nothing.  ``key`` must be unique."""
    rows = _with_ngram_hashes(df.where(F.size(tokens) >= n).select(key, F.col(tokens).alias("_t")), n, "_t", "_h")
    rows = rows.withColumn("_s", F.array_sort(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def same(x, j):
        return F.coalesce(F.get("_s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    grams = F.transform(twice, lambda x: F.slice("_t", x["i"] + 1, n))
    # An outer explode: for an inner one Spark would compute the hashes again in a filter at the scan.
    return (_by_key(rows.select(key, grams.alias("_grams")), key)
            .select(key, F.posexplode_outer("_grams").alias("_p", "ngram")).where(F.col("_p").isNotNull())
            .groupBy(key, "ngram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def banned_next_tokens(df: DataFrame, n: int, tokens: str = "tokens",
                       key: str = "sample_id") -> DataFrame:
    """C14: tokens that would repeat an n-gram if generated next: every token
    that followed the sample's last n-1 tokens earlier in the same sample.

    A scan inside each row: hashes of n-1 tokens are compared with the last
    one, and only where they agree the tokens themselves, so no n-gram is
    shuffled; rows shorter than n give none.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    rows = _with_ngram_hashes(df.where(F.size(tokens) >= n).select(key, F.col(tokens).alias("_t")), n - 1, "_t", "_h")
    last = F.slice("_t", -(n - 1), n - 1)
    def agree(i):
        return F.coalesce(F.get("_h", i - 1) == F.get("_h", F.size("_h") - 1), F.lit(False))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1))),
                      lambda i: agree(i) & (F.slice("_t", i, n - 1) == last))
    nxt = F.array_distinct(F.transform(starts, lambda i: F.get("_t", i + (n - 2))))
    return rows.select(key, F.posexplode_outer(nxt).alias("_p", "token")).where(F.col("_p").isNotNull()).drop("_p")


def ban_tokens(cands: DataFrame, banned: DataFrame, key: str = "sample_id",
               token: str = "token", score: str = "lprob") -> DataFrame:
    """C14: candidates banned for their sample score ``-inf``; no row is dropped."""
    marks = banned.select(F.col(key).alias("_bk"), F.col("token").alias("_bt")).distinct()
    hit = F.col(key).eqNullSafe(F.col("_bk")) & (F.col(token) == F.col("_bt"))
    return cands.join(marks, hit, "left").withColumn(
        score, F.when(F.col("_bt").isNotNull(), F.lit(float("-inf"))).otherwise(F.col(score))
    ).drop("_bk", "_bt")


def expand_prefixes(df: DataFrame, src: str = "src_tokens", tgt: str = "tgt_tokens",
                    horizon: int = -1, key: str = "sample_id", out: str = "tokens",
                    end=None) -> DataFrame:
    """One row per target prefix 1..T placed after the source.

    ``end`` (an end token) is appended to each prefix first; a horizon above 0
    then keeps the last ``horizon + 1`` positions of prefix and end together.
    A horizon of 0 or less cuts nothing.

    Each row slices the kept window straight out of the target, so a row
    costs the window, never the whole prefix.  Without a horizon every prefix
    is whole by definition (output size is quadratic in T, as in the
    reference's loop).
    """
    # An outer explode, filtered after it: else Spark would compute ``tgt`` again in each filter at the scan.
    lengths = F.when(F.size(tgt) > 0, F.sequence(F.lit(1), F.size(tgt)))
    rows = df.select(key, src, tgt, F.explode_outer(lengths).alias("prefix_len")).where(F.col("prefix_len").isNotNull())
    i = F.col("prefix_len")
    if horizon > 0:
        keep = F.least(i, F.lit(horizon + 1 - (end is not None)))
        window = F.slice(tgt, i - keep + 1, keep)
    else:
        window = F.slice(tgt, 1, i)
    if end is not None:
        window = F.concat(window, F.array(F.lit(end)))
    return rows.select(key, "prefix_len", F.concat(F.col(src), window).alias(out))
