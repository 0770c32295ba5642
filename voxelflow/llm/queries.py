"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, lexical_search, license_scan
from .chat_format import op3_chat_format
from .decontamination import op1_decontamination
from .flac import op6_media_flac
from .language_id import op4_language_id
from .ngram_join import op13_ngram_jaccard
from .packing import op5_packing
from .quality import op9_quality_classifier
from .simhash import op10_simhash_near_dedup
from .substring_dedup import op7_substring_dedup
from .suffix_dedup import op8_suffix_array_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_media_flac": op6_media_flac,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op11_centroid_clustering": centroids.oracle(),
    "op12_ranked_search": lexical_search.oracle(),
}
