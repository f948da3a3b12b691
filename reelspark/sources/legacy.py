"""Legacy sentences: a description, then a score of emotion, scene types after a colon or in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene words in their order, words of speech, of description, marks of dialogue, pronouns, words of people.
SCENES = ["战斗", "打斗", "搏斗", "下葬", "入棺", "活埋", "祭坛", "祭祀", "作法", "对峙", "冲突", "独白", "特写", "惊恐", "夜葬", "抬棺", "诡异", "恐怖", "葬礼", "仪式", "空镜", "日常", "对话", "群像", "凝视"]
SPEECH = ["说", "问", "喊", "叫", "道", "言", "语", "诉", "答", "吼", "骂", "曰"]
DESCRIBING = ["情绪", "场景", "光线", "氛围", "画面", "类型", "描述", "表情", "动作"]
DIALOGUE_MARKS = "？！吗呢吧啊呀嘛啦哦噢嗯哎"
PRONOUNS = "我你他她它咱"
PEOPLE = ["人", "众", "者", "员", "男", "女", "老", "少", "汉", "子", "爷", "娘"]

#: From the word for emotion to its figure.
SCORE = r"情绪[评分：:]*\s*(\d+)"


def _held(text: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words)))


def fields(line: Column) -> Column:
    """emotion, has_content, desc_clean, desc_length, scene_types in the order of first mention, dialogue_lines, faces of a legacy sentence.

    What stands before the score is the description; scene types are named behind it (after a colon, then in brackets), and then
    by the description's scene words. A sentence without a score is all description. A description without a word of speech is
    itself one line of dialogue if it has no describing word and has a mark of dialogue, or a pronoun within 30 characters.
    """
    scored = F.regexp_extract(line, SCORE, 0) != ""
    before = F.when(scored, F.regexp_extract(line, rf"(?s)^(.*?){SCORE}", 1)).otherwise(line)
    desc = F.when(scored, F.trim(before)).otherwise(line)
    score = F.when(scored, F.substr(line, F.char_length(before) + 1)).otherwise(F.lit(""))
    cut = lambda x: F.transform(F.split(x, "/"), lambda t: F.trim(t))
    named = cut(F.regexp_extract(score, r"类型[：:]\s*([^\s。，]+)", 1))
    bracketed = F.flatten(F.transform(F.regexp_extract_all(score, F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1)), cut))
    types = F.array_distinct(F.filter(F.concat(named, bracketed, _held(desc, SCENES)), lambda t: t != ""))
    said = F.size(_held(desc, SPEECH))
    mark, pronoun = desc.rlike(f"[{DIALOGUE_MARKS}]"), desc.rlike(f"[{PRONOUNS}]")
    quote = (F.char_length(desc) >= 3) & (F.size(_held(desc, DESCRIBING)) == 0) & (mark | (pronoun & (F.char_length(desc) <= 30)))
    return F.struct(
        F.when(scored, F.regexp_extract(line, SCORE, 1).cast("int")).otherwise(3).alias("emotion"), (F.char_length(desc) > 3).alias("has_content"), desc.alias("desc_clean"), F.char_length(desc).alias("desc_length"),
        types.alias("scene_types"), F.when(said > 0, said).when(quote, 1).otherwise(0).alias("dialogue_lines"), F.least(F.lit(5), F.size(_held(desc, PEOPLE))).alias("faces"),
    )
