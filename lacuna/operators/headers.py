"""Binary headers as projections; records that do not fit are marked, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import bytes as B


def write_image(version: Column, h: Column, w: Column, blocks: Column, block: Column, channels: int = 3, coarse: Column | None = None, residual: Column | None = None) -> Column:
    coarse, residual = coarse if coarse is not None else B.lit_bytes(b""), residual if residual is not None else B.lit_bytes(b"")
    return F.concat(
        B.lit_bytes(B.IMAGE), B.be(version, 1), B.be(h, 4), B.be(w, 4), B.be(F.lit(channels), 1), B.be(blocks, 4), B.be(block, 4), B.be(F.length(coarse), 4), B.be(F.length(residual), 4), coarse, residual
    )


def write_audio(ch: Column, flags: Column, sr: Column, n: Column, blocks: Column, block: Column, version: int = 2, coarse_frames: int = 0, coarse: Column | None = None, residual: Column | None = None) -> Column:
    coarse, residual = coarse if coarse is not None else B.lit_bytes(b""), residual if residual is not None else B.lit_bytes(b"")
    head = [B.lit_bytes(B.AUDIO), B.be(F.lit(version), 1), B.be(ch, 1), B.be(F.lit(2), 1), B.be(flags, 1)]
    return F.concat(*head, *[B.be(c, 4) for c in (sr, n, blocks, block, F.lit(coarse_frames), F.length(coarse), F.length(residual))], coarse, residual)


def _fields(df: DataFrame, layout: list[tuple[str, int, int]]) -> DataFrame:
    return df.withColumns({name: B.from_be(F.col("raw"), at, width).cast("long" if width == 4 else "int") for name, at, width in layout})


def _marked(df: DataFrame, magic: bytes, size: int, versions: list[int], names: list[str]) -> DataFrame:
    ok = (F.length("raw") >= size) & (F.substring("raw", 1, 4) == B.lit_bytes(magic)) & F.col("version").isin(versions)
    ok = ok & (F.col("blocks") > 0) & (F.col("block_id") < F.col("blocks")) & (F.lit(size) + F.col("coarse_len") + F.col("residual_len") <= F.length("raw"))
    ok = F.coalesce(ok, F.lit(False))
    return df.withColumn("status", F.when(ok, "ok").otherwise("invalid")).withColumns({n: F.when(ok, F.col(n)) for n in names})


def parse_image(df: DataFrame) -> DataFrame:
    """``df(raw)`` with version, h, w, c, blocks, block_id, lengths and status."""
    layout = [("version", 4, 1), ("h", 5, 4), ("w", 9, 4), ("c", 13, 1), ("blocks", 14, 4), ("block_id", 18, 4), ("coarse_len", 22, 4), ("residual_len", 26, 4)]
    return _marked(_fields(df, layout), B.IMAGE, 30, [1, 2, 3], [n for n, _, _ in layout])


def parse_audio(df: DataFrame) -> DataFrame:
    layout = [("version", 4, 1), ("ch", 5, 1), ("width", 6, 1), ("flags", 7, 1), ("sr", 8, 4), ("n_frames", 12, 4), ("blocks", 16, 4), ("block_id", 20, 4), ("coarse_frames", 24, 4), ("coarse_len", 28, 4), ("residual_len", 32, 4)]
    return _marked(_fields(df, layout), B.AUDIO, 36, [1, 2, 3], [n for n, _, _ in layout])


def same_geometry(df: DataFrame, field: str, order: str, geometry: list[str]) -> DataFrame:
    """Rows whose geometry equals that of the field's first row, which is found by an aggregate and joined back."""
    first = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("__field")).agg(F.min_by(F.struct(*geometry), order).alias("__f"))
    same = F.struct(*geometry).eqNullSafe(F.col("__f"))
    return df.join(first, F.col(field) == F.col("__field")).where(same).drop("__f", "__field")


def mode_of_name(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".wav"), "audio").otherwise("image")


def layout_of(head: Column) -> Column:
    m = F.substring(head, 1, 4)
    return F.when(m == B.lit_bytes(B.IMAGE), "image").when(m == B.lit_bytes(B.AUDIO), "audio").when(m == B.lit_bytes(B.PACKED), "container").otherwise("unknown")


def decoder_of(version: Column) -> Column:
    return F.when(version == 3, "v3").otherwise("v1_v2")


def path_of(data: Column, chunk_id: Column) -> Column:
    return F.concat(F.when(F.substring(data, 1, 4) == B.lit_bytes(B.RECOVERY), "recovery_").otherwise("chunk_"), chunk_id.cast("string"))


def decoded_name(stem: Column, mode: Column) -> Column:
    return F.concat(stem, F.lit("_decoded"), F.when(mode == "audio", ".wav").otherwise(".png"))


def confidence_name(stem: Column, mode: Column) -> Column:
    return F.concat(stem, F.lit("_conf"), F.when(mode == "audio", ".npy").otherwise(".png"))
