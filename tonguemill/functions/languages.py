"""The language registry and its lookups, as literal maps: no join, no shuffle, no UDF."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, display name, code name, in list order.
LANGUAGES = (
    ("AutoDetect", "自动检测", "auto"), ("Chinese", "中文", "zh"), ("TraditionalChinese", "繁体中文", "zh-Hant"), ("Cantonese", "粤语", "yue"),
    ("English", "英语", "en"), ("French", "法语", "fr"), ("Portuguese", "葡萄牙语", "pt"), ("Spanish", "西班牙语", "es"),
    ("Japanese", "日语", "ja"), ("Turkish", "土耳其语", "tr"), ("Russian", "俄语", "ru"), ("Arabic", "阿拉伯语", "ar"),
    ("Korean", "韩语", "ko"), ("Thai", "泰语", "th"), ("Italian", "意大利语", "it"), ("German", "德语", "de"),
    ("Vietnamese", "越南语", "vi"), ("Malay", "马来语", "ms"), ("Indonesian", "印尼语", "id"), ("Filipino", "菲律宾语", "tl"),
    ("Hindi", "印地语", "hi"), ("Polish", "波兰语", "pl"), ("Czech", "捷克语", "cs"), ("Dutch", "荷兰语", "nl"),
    ("Khmer", "高棉语", "km"), ("Burmese", "缅甸语", "my"), ("Persian", "波斯语", "fa"), ("Gujarati", "古吉拉特语", "gu"),
    ("Urdu", "乌尔都语", "ur"), ("Telugu", "泰卢固语", "te"), ("Marathi", "马拉地语", "mr"), ("Hebrew", "希伯来语", "he"),
    ("Bengali", "孟加拉语", "bn"), ("Tamil", "泰米尔语", "ta"), ("Ukrainian", "乌克兰语", "uk"), ("Tibetan", "藏语", "bo"),
    ("Kazakh", "哈萨克语", "kk"), ("Mongolian", "蒙古语", "mn"), ("Uyghur", "维吾尔语", "ug"),
)
UNKNOWN_DISPLAY, AUTO = "未知语言", "auto"


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "ordinal int, code string, display_name string, code_name string")


def _lookup(key: Column, pairs, default: str) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(pairs)))
    return F.coalesce(F.when(key.isNotNull(), F.try_element_at(table, key)), F.lit(default))


def display_name(code: Column) -> Column:
    return _lookup(code, [(c, d) for c, d, _ in LANGUAGES], UNKNOWN_DISPLAY)


def code_name(code: Column) -> Column:
    return _lookup(code, [(c, n) for c, _, n in LANGUAGES], AUTO)


def from_display_name(name: Column) -> Column:
    return _lookup(name, [(d, c) for c, d, _ in LANGUAGES], "AutoDetect")


def from_code_name(name: Column) -> Column:
    return _lookup(name, [(n, c) for c, _, n in LANGUAGES], "AutoDetect")


def language_pairs(spark: SparkSession) -> DataFrame:
    """Every source with every target but automatic detection: 39 x 38 rows, fixed."""
    rows = languages(spark)
    target = rows.where("code <> 'AutoDetect'").select(F.col("code_name").alias("target_lang"), F.col("display_name").alias("target_display"))
    return rows.select(F.col("code_name").alias("source_lang"), F.col("display_name").alias("source_display")).crossJoin(F.broadcast(target))
