"""Translation in six frames and open reading frames.

Frames 1 to 3 begin at bases 1 to 3, frames 4 to 6 at the first three of the reverse complement.

Sequences that come in parts (parts.py) are read in chunks of whole codons.  What lies between two stops of a chunk is
found there; before its first stop and after its last the stretch is open, and each chunk gives those two ends (or one, if it has no
stop).  An end after a stop opens a new stretch, so a running count of such ends numbers the stretches, and an aggregate joins
the ends of each; no row or group holds a sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codons import codon_table, isoelectric_point, molecular_weight, reverse_translate, translate
from ..functions.sequence import reverse_complement
from ..sources.files import written
from .match import chunked
from .parts import is_parts, twin

FRAMES = (1, 2, 3, 4, 5, 6)
#: Bases of a chunk of a sequence in parts: whole codons in every frame.
CODON_CHUNK = 3 << 15


def frames(seqs: DataFrame, which: Sequence[int] = FRAMES, table: int = 0, letters: int = 1) -> DataFrame:
    """seq_id, seq_len, frame, protein."""
    parts = [F.struct(F.lit(f).alias("frame"), translate("seq" if f <= 3 else reverse_complement("seq"), (f - 1) % 3 + 1, table, letters).alias("protein")) for f in which]
    return seqs.select("seq_id", F.length("seq").cast("long").alias("seq_len"), F.explode(F.array(*parts)).alias("f")).select("seq_id", "seq_len", F.col("f.frame").alias("frame"), F.col("f.protein").alias("protein"))


def translations(seqs: DataFrame, tables: Sequence[int], letters_at_once: int = 1 << 20) -> DataFrame:
    """seq_id, code, protein: frame 1 by each of the codon tables; a sequence's codons are numbered once for all of them."""
    kind = seqs.schema["seq_id"].dataType.simpleString()
    residues = {k: codon_table(k) for k in tables}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from .scan import codon_numbers

        codes = {k: np.frombuffer("".join([*(t[a + b + c] for a in "acgt" for b in "acgt" for c in "acgt"), "X"]).encode(), dtype=np.uint8) for k, t in residues.items()}
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("seq")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters_at_once, side="right")))
                some = b.slice(at, to - at)
                at = to
                number, edge = codon_numbers(some.column("seq"))
                for k, code in codes.items():
                    protein = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(edge), pa.py_buffer(code[number])]).cast(pa.string())
                    protein = pc.if_else(pc.is_null(some.column("seq")), pa.scalar(None, pa.string()), protein)
                    yield pa.RecordBatch.from_arrays([some.column("seq_id"), pa.array(np.full(len(some), k, dtype=np.int32)), protein], names=["seq_id", "code", "protein"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, code int, protein string")


def orfs(seqs: DataFrame, least: int = 30, which: Sequence[int] = FRAMES, table: int = 0, require_met: bool = True, chunk: int = CODON_CHUNK) -> DataFrame:
    """Stretches between stops of at least ``least`` (1 or more) residues, found in arrays per Arrow batch: orf_no, aa_begin, aa_end, aa_len, bp_begin, bp_end, peptide.

    With require_met they begin at the first M; the stretch at the sequence's start counts as already inside.
    Base positions are on the frame's own strand.  Sequences are rows, or come in parts; parts are read in chunks of ``chunk`` bases.
    """
    if is_parts(seqs):
        return _orfs_of_parts(seqs, least, which, table, require_met, chunk)
    kind = seqs.schema["seq_id"].dataType.simpleString()
    residues = codon_table(table)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .scan import find_orfs

        code = np.frombuffer("".join([*(residues[a + b + c] for a in "acgt" for b in "acgt" for c in "acgt"), "X"]).encode(), dtype=np.uint8)
        for b in batches:
            for frame, row, begin, peptide in find_orfs(b.column("seq"), code, tuple(which), least, require_met):
                n = np.diff(np.frombuffer(peptide.buffers()[1], dtype=np.int64))
                first = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)[: len(row)]
                number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1 if len(row) else row
                start = (frame - 1) % 3 + (begin - 1) * 3
                columns = [b.column("seq_id").take(pa.array(row)), pa.array(np.full(len(row), frame, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in (begin, begin + n - 1, n, start + 1, start + 3 * n)), peptide.cast(pa.string()), pa.array(number.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "frame", "aa_begin", "aa_end", "aa_len", "bp_begin", "bp_end", "peptide", "orf_no"])

    return seqs.select("seq_id", "seq").where("seq IS NOT NULL").mapInArrow(run, f"seq_id {kind}, frame int, aa_begin long, aa_end long, aa_len long, bp_begin long, bp_end long, peptide string, orf_no long")


def frame_parts(parts: DataFrame, which: Sequence[int] = FRAMES, table: int = 0, letters: int = 1, chunk: int = CODON_CHUNK) -> DataFrame:
    """Frames of sequences in parts, a row for each chunk: seq_id, seq_len, frame, aa_begin (the first residue's number), protein."""
    out = None
    for down, own in ((False, [f for f in which if f <= 3]), (True, [f for f in which if f > 3])):
        if own:
            pieces = chunked(twin(parts) if down else parts, 2, chunk=chunk)
            each = [F.struct(F.lit(f).alias("frame"), translate(F.substring("piece", (f - 1) % 3 + 1, chunk), 1, table, letters).alias("protein")) for f in own]
            rows = pieces.select("seq_id", "seq_len", (F.floor(F.col("base") / 3) + 1).alias("aa_begin"), F.explode(F.array(*each)).alias("f")).select("seq_id", "seq_len", "f.frame", "aa_begin", "f.protein").where("protein <> ''")
            out = rows if out is None else out.unionByName(rows)
    return out


_INSIDE, _HEAD, _TAIL = 0, 1, 2


def _orfs_of_parts(parts: DataFrame, least: int, which: Sequence[int], table: int, require_met: bool, chunk: int) -> DataFrame:
    if chunk % 3:
        raise ValueError("chunks are whole codons")
    kind = parts.schema["seq_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for k in range(b.num_rows):
                rows = list(_open_and_closed(b.column("protein")[k].as_py(), b.column("aa_begin")[k].as_py(), least, require_met))
                n, frame, at = len(rows), b.column("frame")[k].as_py(), b.column("aa_begin")[k].as_py()
                columns = [[frame] * n, [at] * n, *zip(*rows)] if n else [[]] * 7
                where = pa.array([k] * n, type=pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("seq_id").take(where), *(pa.array(list(c), type=t) for c, t in zip(columns, types))], names=["seq_id", "frame", "chunk", "kind", "begin", "end", "met", "residues"])

    proteins = frame_parts(parts, which, table, chunk=chunk).select("seq_id", "frame", "aa_begin", "protein")
    # Written, as the numbering below reads them four times.
    rows = written(proteins.mapInArrow(run, f"seq_id {kind}, frame int, chunk long, kind int, begin long, end long, met long, residues string"), "stretches")
    closed = rows.where(F.col("kind") == _INSIDE).select("seq_id", "frame", "begin", "end", "residues")
    # Ends of chunks: two rows at most for each chunk and frame.
    by = Window.partitionBy("seq_id", "frame").orderBy("chunk", "kind")
    ends = rows.where(F.col("kind") != _INSIDE).withColumn("stretch", F.sum((F.col("kind") == _TAIL).cast("int")).over(by))
    joined = ends.groupBy("seq_id", "frame", "stretch").agg(F.min("begin").alias("first"), F.max("end").alias("end"), F.min("met").alias("met"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "residues"))), lambda x: x["residues"]), "").alias("all"))
    begin = F.when((F.col("stretch") > 0) & F.lit(require_met), F.col("met")).otherwise(F.col("first"))
    joined = joined.withColumn("begin", begin).where(F.col("begin").isNotNull() & (F.col("end") - F.col("begin") + 1 >= max(least, 1)))
    joined = joined.select("seq_id", "frame", "begin", "end", F.substring("all", (F.col("begin") - F.col("first") + 1).cast("int"), (F.col("end") - F.col("begin") + 1).cast("int")).alias("residues"))
    found = closed.unionByName(joined).withColumn("_k", F.floor(F.col("begin") / F.lit(chunk)))
    # Numbers in two levels: within a stretch of residues, and over the stretches' counts.
    count = found.groupBy("seq_id", "frame", "_k").agg(F.count(F.lit(1)).alias("_n"))
    count = count.select("seq_id", "frame", "_k", (F.sum("_n").over(Window.partitionBy("seq_id", "frame").orderBy("_k")) - F.col("_n")).alias("_skip"))
    found = found.withColumn("_place", F.row_number().over(Window.partitionBy("seq_id", "frame", "_k").orderBy("begin"))).join(count, ["seq_id", "frame", "_k"])
    start = (F.col("frame") - 1) % 3 + (F.col("begin") - 1) * 3
    n = F.col("end") - F.col("begin") + 1
    return found.select("seq_id", "frame", F.col("begin").alias("aa_begin"), F.col("end").alias("aa_end"), n.alias("aa_len"), (start + 1).alias("bp_begin"), (start + 3 * n).alias("bp_end"), F.col("residues").alias("peptide"), (F.col("_skip") + F.col("_place")).alias("orf_no"))


def _open_and_closed(protein: str, first: int, least: int, require_met: bool):
    """kind, begin, end, met (first M), residues of a chunk's stretches; first: the number of its first residue."""
    stop = protein.find("*")
    met = lambda lo, hi: first + at if (at := protein.find("M", lo, hi)) >= 0 else None
    yield _HEAD, first, first + (len(protein) if stop < 0 else stop) - 1, met(0, len(protein) if stop < 0 else stop), protein if stop < 0 else protein[:stop]
    while stop >= 0:
        begin, stop = stop + 1, protein.find("*", stop + 1)
        if stop < 0:
            yield _TAIL, first + begin, first + len(protein) - 1, met(begin, len(protein)), protein[begin:]
            return
        lo = protein.find("M", begin, stop) if require_met else begin
        if lo >= 0 and stop - lo >= max(least, 1):
            yield _INSIDE, first + lo, first + stop - 1, None, protein[lo:stop]


def orf_properties(found: DataFrame) -> DataFrame:
    """With molecular weight (kD) and isoelectric point."""
    return found.select("*", molecular_weight("peptide").alias("mol_wt_kd"), isoelectric_point("peptide").alias("pi"))


def composition(found: DataFrame) -> DataFrame:
    """Residues of each open reading frame: aa, n, percent."""
    rows = found.select("seq_id", "frame", "orf_no", "aa_len", F.explode(F.regexp_extract_all("peptide", F.lit("(.)"), F.lit(1))).alias("aa"))
    return rows.groupBy("seq_id", "frame", "orf_no", "aa", "aa_len").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.col("aa_len"), 4)).drop("aa_len")


def starts_and_stops(seqs: DataFrame, which: Sequence[int] = FRAMES, table: int = 0) -> DataFrame:
    """Residue numbers of every M (positive) and stop (negative)."""
    rows = frames(seqs, which, table).select("seq_id", "frame", F.posexplode(F.regexp_extract_all("protein", F.lit("(.)"), F.lit(1))).alias("k", "aa")).where("aa IN ('M', '*')")
    return rows.select("seq_id", "frame", F.when(F.col("aa") == "M", F.col("k") + 1).otherwise(-(F.col("k") + 1)).cast("long").alias("place"))


def codon_usage(seqs: DataFrame, frame: int = 1) -> DataFrame:
    from ..functions.codons import codons

    return seqs.select(F.explode(codons("seq", frame)).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


def silent(seqs: DataFrame, table: int = 0) -> DataFrame:
    """Each sequence as the IUPAC sequence of all that translate alike in frame 1: search it with mode "subset"."""
    return seqs.select("seq_id", reverse_translate(translate("seq", 1, table), table).alias("seq"))


def fasta(found: DataFrame) -> DataFrame:
    """Two-line records of open reading frames."""
    return found.select("seq_id", "frame", "orf_no", F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" frame "), F.col("frame").cast("string"), F.lit(" orf "), F.col("orf_no").cast("string"), F.lit(" bases "), F.col("bp_begin").cast("string"), F.lit("-"), F.col("bp_end").cast("string"), F.lit("\n"), F.col("peptide")).alias("record"))


def orf_map(found: DataFrame, seqs: DataFrame, width: int) -> DataFrame:
    """First and last column of each open reading frame on a map of ``width`` columns, on the top strand's coordinates."""
    long = found.join(seqs.select("seq_id", F.length("seq").cast("long").alias("seq_len")), "seq_id")
    down = F.col("frame") > 3
    lo = F.when(down, F.col("seq_len") - F.col("bp_end") + 1).otherwise(F.col("bp_begin"))
    hi = F.when(down, F.col("seq_len") - F.col("bp_begin") + 1).otherwise(F.col("bp_end"))
    cell = lambda c: F.floor((c - 1) * F.lit(width) / F.col("seq_len")).cast("long")
    return long.select("seq_id", "frame", "orf_no", cell(lo).alias("first_cell"), cell(hi).alias("last_cell"))


def cotranslation(seqs: DataFrame, which: Sequence[int] = (1, 2, 3), width: int = 60, letters: int = 1, table: int = 0) -> DataFrame:
    """Residues under each line of a linear map: codons that begin in the line, per frame 1 to 3."""
    lines = chunked(seqs, 2, chunk=width).withColumn("k", F.floor(F.col("base") / width))
    parts = [F.struct(F.lit(f).alias("frame"), translate(F.substring("piece", f, width), 1, table, letters).alias("protein")) for f in which]
    return lines.select("seq_id", F.col("k").cast("long").alias("block_no"), F.explode(F.array(*parts)).alias("x")).select("seq_id", "block_no", "x.frame", "x.protein")
