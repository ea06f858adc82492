"""Model folders as relations: listings, weight resolution, quantisation planning.

``files(dir, name, size)`` comes from a listing that never reads contents.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names of decoder files by preference.
PREFERRED_GGUF = ["model-q8_0.gguf", "model-q6k.gguf", "model-q6_k.gguf", "model-q4_0.gguf", "model.gguf"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(dir, name, size)`` of all files below ``root``; contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"))


def preferred_gguf(files: DataFrame, order: list[str] = PREFERRED_GGUF) -> DataFrame:
    """The first existing name of the preference list per folder."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    return files.where(F.col("name").isin(order)).groupBy("dir").agg(F.min_by("name", rank).alias("preferred_gguf"))


def first_file(files: DataFrame, suffix: str) -> DataFrame:
    """The smallest name with a suffix per folder (in place of the first that a listing happens to give)."""
    return files.where(F.col("name").endswith(suffix)).groupBy("dir").agg(F.min("name").alias("file"))


def gguf_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").endswith(".gguf")).groupBy("dir").agg(F.sort_array(F.collect_list("name")).alias("gguf_files"))


def resolve_weights(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """Weight files per folder ``(dir, weights, error)``: the single file, else the index's distinct shards, else numbered shards.

    ``indexes(dir, json)`` are the contents of ``model.safetensors.index.json``.
    """
    shard_map = F.from_json("json", "weight_map map<string,string>")["weight_map"]
    listed = indexes.select("dir", F.sort_array(F.array_distinct(F.map_values(shard_map))).alias("shards"))
    own = files.groupBy("dir").agg(
        F.max(F.col("name") == "model.safetensors").alias("single"),
        F.sort_array(F.collect_list(F.when(F.col("name").rlike(r"^model-.*-of-.*\.safetensors$"), F.col("name")))).alias("numbered"),
        F.collect_set("name").alias("names"),
    )
    both = own.join(listed, "dir", "left").join(indexes.select("dir", F.lit(True).alias("indexed")), "dir", "left")
    missing = F.array_except(F.coalesce("shards", F.array().cast("array<string>")), F.col("names"))
    by_index = F.coalesce("indexed", F.lit(False)) & ~F.col("single")
    empty = F.coalesce(F.size("shards") <= 0, F.lit(True))
    error = F.when(by_index & empty, "empty weight map").when(by_index & (F.size(missing) > 0), F.concat(F.lit("missing shard "), missing[0])).when(~F.col("single") & ~by_index & (F.size("numbered") == 0), "no safetensors")
    weights = F.when(F.col("single"), F.array(F.lit("model.safetensors"))).when(by_index, F.col("shards")).otherwise(F.col("numbered"))
    return both.select("dir", F.when(error.isNull(), weights).alias("weights"), error.alias("error"))


def inspect(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """One row per model folder: what is there, what would be used, and what it is ready for."""
    has = {f"has_{k}": F.max(F.col("name") == v) for k, v in (("config", "config.json"), ("vocab", "vocab.json"), ("merges", "merges.txt"), ("mel_filters", "mel_filters.bin"))}
    base = files.groupBy("dir").agg(*(v.alias(k) for k, v in has.items()))
    weights = resolve_weights(files, indexes)
    used = weights.select("dir", F.explode("weights").alias("name")).join(files, ["dir", "name"]).groupBy("dir").agg(F.sum("size").alias("weights_bytes"), F.count("*").alias("weight_files"))
    out = base.join(gguf_files(files), "dir", "left").join(preferred_gguf(files), "dir", "left").join(weights, "dir", "left").join(used, "dir", "left")
    ready = F.col("has_config") & F.col("has_vocab") & F.col("has_merges") & F.col("weights").isNotNull()
    return out.withColumns({"ready_transcribe": ready, "ready_quantize": F.col("weights").isNotNull()}).orderBy("dir")


def quantizable(name: Column, rank: Column, embeddings: Column | bool = False) -> Column:
    """Whether a tensor is put into blocks: a matrix of weights, no norm, an embedding only if asked for."""
    embeddings = F.lit(embeddings) if isinstance(embeddings, bool) else embeddings
    return (rank == 2) & name.endswith(".weight") & ~F.contains(name, F.lit("norm")) & (~F.contains(name, F.lit("embed_tokens.weight")) | embeddings)


def quantize_plan(tensors: DataFrame, scope: str, embeddings: bool = False) -> DataFrame:
    """``tensors(name, rank, bytes)`` below a name prefix, with what becomes of each."""
    return tensors.where(F.col("name").startswith(scope)).withColumn("quantize", quantizable(F.col("name"), F.col("rank"), embeddings))


def weight_summary(tensors: DataFrame) -> DataFrame:
    """Tensors and bytes by the first part of their dotted names."""
    return tensors.groupBy(F.split("name", "\\.")[0].alias("scope")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def config_value(json_text: Column, path: str, default: object) -> Column:
    """A value of a JSON config by path, with a default where it is missing."""
    return F.coalesce(F.get_json_object(json_text, path), F.lit(str(default)))


def strict_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON config of a fixed schema; anything malformed is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def vocabulary(texts: DataFrame, shape: str) -> DataFrame:
    """``texts(json)`` to ``(id, piece)``; shape is token_to_id, id_to_piece (other keys go) or piece_to_record."""
    if shape == "token_to_id":
        return texts.select(F.explode(F.from_json("json", "map<string,int>")).alias("piece", "id")).select("id", "piece")
    if shape == "id_to_piece":
        rows = texts.select(F.explode(F.from_json("json", "map<string,string>")).alias("key", "piece"))
        return rows.select(F.col("key").try_cast("int").alias("id"), "piece").where("id is not null")
    if shape == "piece_to_record":
        rows = texts.select(F.explode(F.from_json("json", "map<string,struct<id:int,score:double>>")).alias("piece", "r"))
        return rows.select(F.col("r.id").alias("id"), "piece")
    raise ValueError(f"no vocabulary shape {shape}")


def tokenizer_vocabulary(texts: DataFrame) -> DataFrame:
    """``texts(json)`` of ``tokenizer.json`` files to ``(id, piece, special)``: the model's pieces and the added tokens."""
    spec = F.from_json("json", "model struct<vocab:map<string,int>>, added_tokens array<struct<id:int,content:string,special:boolean>>")
    own = texts.select(F.explode(spec["model"]["vocab"]).alias("piece", "id")).select("id", "piece", F.lit(False).alias("special"))
    added = texts.select(F.explode(spec["added_tokens"]).alias("t")).select(F.col("t.id").alias("id"), F.col("t.content").alias("piece"), F.coalesce("t.special", F.lit(False)).alias("special"))
    return own.join(added, "id", "left_anti").unionByName(added)


def safetensors_header(content: bytes) -> list[tuple[str, str, list[int], int, int]]:
    """(name, dtype, shape, begin, end) of each tensor of a safetensors file, from its JSON header."""
    size = int.from_bytes(content[:8], "little")
    head = json.loads(content[8 : 8 + size])
    return [(k, v["dtype"], v["shape"], v["data_offsets"][0] + 8 + size, v["data_offsets"][1] + 8 + size) for k, v in sorted(head.items()) if k != "__metadata__"]
