"""Column functions on texts: prompts, cleaning, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonguemill.functions.languages import display_name, from_code_name

# Wording of the prompts and of the chat wrap.
TRANSLATE_FROM, TRANSLATE_TEXT, INTO, ONLY = "将以下", "文本翻译为", "将以下文本翻译为", "，注意只需要输出翻译后的结果，不要额外解释：\n\n"
CHAT_OPEN, CHAT_CLOSE = "<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
OCR_PREFIXES = {"table": "Table Recognition:", "formula": "Formula Recognition:", "chart": "Chart Recognition:", "spotting": "Spotting:", "seal": "Seal Recognition:"}
OCR_TASKS = ("ocr", "table", "formula", "chart", "spotting", "seal")


def chat(content: Column) -> Column:
    return F.concat(F.lit(CHAT_OPEN), content, F.lit(CHAT_CLOSE))


def build_prompt(text: Column, source: Column, target: Column) -> Column:
    """Prompt for a translation between code names; without the source's name where it is to be detected."""
    code = from_code_name(source)
    tail = F.concat(display_name(from_code_name(target)), F.lit(ONLY), text)
    known = F.concat(F.lit(TRANSLATE_FROM), display_name(code), F.lit(TRANSLATE_TEXT), tail)
    return chat(F.when(code == "AutoDetect", F.concat(F.lit(INTO), tail)).otherwise(known))


def ocr_task_type(choice: Column) -> Column:
    task = F.lit(OCR_TASKS[0])
    for i, name in enumerate(OCR_TASKS):
        task = F.when(choice == i, name).otherwise(task)
    return task


def ocr_prompt(task: Column, marker: str = "<__media__>") -> Column:
    prefix = F.lit("OCR:")
    for name, words in OCR_PREFIXES.items():
        prefix = F.when(task == name, words).otherwise(prefix)
    return chat(F.concat(F.lit(marker + "\n"), prefix))


def trim_artifacts(text: Column) -> Column:
    """Without trailing space, line feed, carriage return, tab."""
    return F.rtrim(text, F.lit(" \n\r\t"))


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def char_count(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def utf16_count(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")
