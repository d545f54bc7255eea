"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, language, middle, minhash, mixing, ogg, packing, quality, runs, secrets, seed_extend, suffixes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_order_minhash": minhash.op3_order_minhash,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_seed_extend": seed_extend.op5_seed_extend,
        "op6_line_quality": quality.op6_line_quality,
        "op7_unigram_langid": language.op7_unigram_langid,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_ogg_media": ogg.op9_ogg_media,
        "op10_warc_zstd": warc.op10_warc_zstd,
        "op11_fill_in_middle": middle.op11_fill_in_middle,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_addressable_codes": codes.op13_addressable_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {**mixing.SQL, **quality.SQL, **warc.SQL, **middle.SQL}
