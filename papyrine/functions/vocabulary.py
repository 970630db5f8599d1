"""The controlled vocabularies of catalogue fields and their English glosses."""

from __future__ import annotations

# Kinds of material.
MATERIAL = {
    "письмо": "letter", "письма": "letters", "статья": "article", "статьи": "articles", "фотография": "photograph", "фотографии": "photographs",
    "портрет": "portrait", "портреты": "portraits", "таблицы": "tables", "чертежи": "technical drawings", "формулы": "formulae", "рисунки": "drawings",
    "автобиография": "autobiography", "воспоминания": "memoirs", "монография": "monograph", "брошюра": "booklet", "отрывок": "extract", "отрывки": "extracts",
    "отрывок статьи": "extract from an article", "отрывки статьи": "extracts from an article", "фрагмент": "fragment", "фрагменты": "fragments",
    "фрагменты статьи": "fragments of an article", "фрагменты статей": "fragments of articles", "фрагменты работ": "fragments of works",
    "заметка": "note", "заметки": "notes", "записка": "memorandum", "записки": "memoranda", "записи": "records", "конспекты": "synopses",
    "выписка": "excerpt", "выписки": "excerpts", "предисловие": "preface", "главы": "chapters", "проект": "design", "план": "plan", "план работ": "work plan",
    "очерк": "essay", "обзор": "survey", "отзыв": "review", "заключение": "opinion", "замечания к статье": "remarks on an article",
    "добавление к статье": "addendum to an article", "ответ на возражения": "reply to objections", "адреса": "addresses of greeting",
    "протокол": "minutes", "доклад": "report", "отчёт": "account", "описание": "description", "описание работ": "description of works",
    "описание конструкции": "description of a construction", "расчёт": "calculation", "расчёты": "calculations", "вычисления": "computations",
    "набросок": "sketch", "наброски": "sketches", "набросок статьи": "sketch of an article", "черновики": "drafts", "шаблоны": "templates",
    "телеграмма": "telegram", "телеграммы": "telegrams", "извещения": "notifications", "объявление": "announcement", "заявление": "statement",
    "обращение": "appeal", "ответ": "reply", "ответы": "replies", "анкета": "questionnaire", "учётная карточка": "record card",
    "инструкция": "instructions", "смета": "estimate", "программа": "programme", "программа лекций": "lecture programme", "лекция": "lecture",
    "текст выступления": "text of an address", "список работ": "list of works", "путеводитель": "guide", "материалы": "materials",
    "материалы к ней": "materials for it", "конверты": "envelopes", "объяснительная записка": "explanatory memorandum",
}
# Ways of reproduction.
REPRODUCTION = {
    "автограф": "autograph", "машинопись": "typescript", "машинопись с правкой автора": "typescript with the author's corrections", "рукопись": "manuscript",
    "фото": "photograph", "фотографии": "photographs", "фотокопия": "photocopy", "газетные вырезки": "newspaper cuttings",
    "типографская печать": "letterpress", "гектограф": "hectograph", "ксерокопия": "xerox copy",
}
# Languages.
LANGUAGE = {
    "русский": "Russian", "английский": "English", "немецкий": "German", "французский": "French", "украинский": "Ukrainian", "польский": "Polish",
    "испанский": "Spanish", "итальянский": "Italian", "турецкий": "Turkish", "латынь": "Latin", "эсперанто": "Esperanto", "чешский": "Czech",
    "болгарский": "Bulgarian", "японский": "Japanese", "шведский": "Swedish",
}

GLOSSES = {"материал": MATERIAL, "воспроизведение": REPRODUCTION, "язык": LANGUAGE}
