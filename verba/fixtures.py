"""Small dictionaries, entries, rules and documents for golden queries and tests.

Readings, terms, queries, dates and inflections are fixed values of the behaviour
that they test.  Entries, rules and documents are bulletins of a made-up river
survey; each line stands for itself.
"""

from __future__ import annotations

from verba.operators.lookup import Profile

# Word readings: form | normal | tag | kind | * if predicted
READINGS = """
кот|кот|NOUN,anim,masc sing,nomn|base|
кота|кот|NOUN,anim,masc sing,gent|base|
пса|пёс|NOUN,anim,masc sing,gent|base|
стали|сталь|NOUN,inan,femn sing,gent|base|
стали|стать|VERB,perf,intr plur,past,indc|base|
в|в|PREP|base|
и|и|CONJ|base|
с|с|PREP|base|
с|село|NOUN|abbrev|
селе|село|NOUN,inan,neut sing,loct|base|
с.|село|NOUN|abbrev|
с.|сын|NOUN|abbrev|
сын|сын|NOUN|abbrev|
сын|сын|NOUN,anim,masc sing,nomn|base|
город|город|NOUN|abbrev|
ц.|церковь|NOUN|abbrev|
г.|город|NOUN|abbrev|
г.|год|NOUN|abbrev|
кр-нин|крестьянин|NOUN|abbrev|
петербург|петербург|NOUN,inan,masc,Geox sing,nomn|base|
губ|губа|NOUN,inan,femn plur,gent|base|
губ|губерния|NOUN|abbrev|
дорожкиной|дорожкина|NOUN,anim,femn sing,gent|base|*
кузнецова|кузнецов|NOUN,anim,masc,Surn sing,gent|base|
кузнецова|кузнецова|ADJF|base|*
покровского|покровский|ADJF,Geox masc,sing,gent|base|
ивана|иван|NOUN,anim,masc,Name sing,gent|base|
дер|деревня|NOUN|abbrev|
дер|дерь|NOUN|abbrev|*
мороза|мороз|NOUN,anim,masc,Surn sing,gent|surname|*
"""

PROFILES = {
    "text": Profile("text"),
    "name": Profile("name", ("base", "surname", "given", "patronymic"), {"base": ("Name", "Surn", "Patr")}),
    "place": Profile("place", ("base", "toponym", "abbrev"), {"base": ("Geox",)}),
}

# Index terms: profile | text | terms
INDEX_CASES = """
text|Кота|кота=кот[]
text|пса|пса=пес[]
text|стали|стали=сталь[ambiguous],стать[ambiguous]
text|кот в селе|кот=кот[]; селе=село[]
text|с. Кота|с.=село[ambiguous,abbrev],сын[ambiguous,abbrev]; кота=кот[]
text|кот.|кот=кот[]
text|кр-нин|кр-нин=крестьянин[abbrev]
text|Санктъ-Петербургъ|санкт-петербург=санкт-петербург[unknown]; санкт=санкт[unknown]; петербург=петербург[]
text|губ|губ=губа[ambiguous],губерния[ambiguous,abbrev]
text|дер|дер=деревня[abbrev]
name|мороза|мороза=мороза[unknown]
text|Дорожкиной|дорожкиной=дорожкина[predicted]
text|Кузнецова|кузнецова=кузнецов[]
text|Дарожкн 1834|дарожкн=дарожкн[unknown]; 1834=1834[unknown]
text|Покровскаго|покровскаго=покровский[reform]
name|стали|стали=стали[unknown]
name|Ивана|ивана=иван[]
place|с.|с.=село[ambiguous,abbrev],сын[ambiguous,abbrev]
text|Kот|кот=кот[]
text|Kотw|от=от[unknown]
text|ц. Кота|ц.=церковь[ambiguous,abbrev]; кота=кот[]
text|с Кота|кота=кот[]
text|Mississippi кот|кот=кот[]
text|кот, кот!|кот=кот[]; кот=кот[]
"""

# Full terms: text | terms (a term without lemmas shows its text)
FULL_CASES = """
Кот в селе, 1834 г. Mississippi!|кот=кот[]; в=в[stop]; селе=село[]; ,; 1834=1834[unknown]; г.=город[ambiguous,abbrev],год[ambiguous,abbrev]; .; mississippi=mississippi[unknown]; !
с Кота|с=с[stop]; кота=кот[]
Санктъ-Петербургъ|санкт-петербург=санкт-петербург[unknown]
кр-нин|кр-нин=крестьянин[abbrev]
город.|город=город[]; .
Покровскаго|покровскаго=покровский[reform]
"""

# Queries: text | terms | partial term, or - for none
QUERY_CASES = """
Кота Покро|кота=кот[]|покро=покро[unknown]
Кота Покро |кота=кот[]; покро=покро[unknown]|-
в Покро||покро=покро[unknown]
Кота||кота=кот[]
кот в|кот=кот[]|в=
с.|с.=село[ambiguous,abbrev],сын[ambiguous,abbrev]|-
1834|1834=1834[unknown]|-
Кота!|кота=кот[]|-
"""

# A vocabulary of water-level bulletins: kind | lemma | tag | forms
VOCABULARY = """
base|река|NOUN,inan,femn sing,nomn|река реки реке реку
base|пост|NOUN,inan,masc sing,nomn|пост поста посту
base|лед|NOUN,inan,masc sing,nomn|лед льда льду
base|вода|NOUN,inan,femn sing,nomn|вода воды воде
base|метр|NOUN,inan,masc sing,nomn|метр метра метров
base|разлив|NOUN,inan,masc sing,nomn|разлив разлива
base|светлый|ADJF|светлый светлая светлую светлой
base|старый|ADJF|старый старого старому
base|у|PREP|у
base|и|CONJ|и
abbrev|озеро|NOUN,inan,neut|оз оз.
abbrev|метр|NOUN,inan,masc|м м.
hydronym|кедровка|NOUN,femn,Geox|кедровка кедровки кедровке кедровку
hydronym|светлая|ADJF,femn,Geox|светлая светлой светлую
hydronym|налимье|NOUN,neut,Geox|налимье налимья налимью
"""
PREDICTED = (("журавлихе", "журавлиха", "NOUN,inan,femn,Geox sing,loct"),)
KINDS = ("base", "abbrev", "hydronym")
NER_PROFILES = {"text": Profile("text", KINDS), "water": Profile("water", ("base", "hydronym"), {"base": ("Geox",)})}
TYPE_PROFILES = {"river": "water", "lake": "water"}

# Gazetteer lines: type, ref, canonical, alias, flags, attributes
ENTRIES = """
river|w:10|Кедровка|Кедровка||bed=stone
river|w:10|Кедровка|Кедровская протока||bed=stone
river|w:11|Светлая|Светлая|requires_context|
lake|w:20|Налимье|Налимье||
lake|w:21|Налимье|Налимье||
lake|w:22|Чистое|Чистое|surface_only|
unit|u:1|метр|метр||
unit|u:1|метр|м.||
office|o:1|ГП|ГП|case_sensitive|
station|s:1|Устье|Устье||
station|s:2|Яр|Яр|blocked|
"""

RULES = """
meta: {scope: bulletins}
sets:
  - name: waters
    hints:
      - {lemma: река|вода, type: river, dir: both, window: 2, weight: 1.5}
      - {lemma: оз, dotted: true, type: lake, dir: right, window: 1, weight: 2, absorb: true}
    triggers:
      - {lemma: пост, type: station, dir: right, window: 1..3, shape: {case: title}, stop_at: [punct, number], weight: 2}
      - {lemma: старый, type: station, dir: right, window: 1..1, shape: {case: title}, negative: true, weight: 4}
  - name: cold
    when: ["season:winter", "area:north"]
    hints:
      - {lemma: лед, type: river, dir: left, window: 3, weight: 1}
  - name: levels
    patterns:
      - name: level
        elements:
          - {type: river|lake, role: where}
          - {any: true, repeat: "?"}
          - {token: number, role: value}
          - {type: unit}
        actions:
          - label: {role: value, type: level, weight: 1}
          - boost: {role: where, weight: 0.5}
          - emit: {kind: measured, args: {at: where, level: value}}
      - name: flood
        elements:
          - {lemma: разлив}
          - {type: river, role: where}
        actions:
          - relabel: {role: where, type: hazard, weight: 1}
      - name: system
        elements:
          - group:
              - {type: lake}
              - {token: punct}
              - {type: river}
            role: all
        actions:
          - label: {role: all, type: basin, weight: 1}
"""
NESTING = {"basin": ("lake", "river")}

# Documents: id | tags | text | spans as type:surface, in order
DOCUMENTS = """
plain||по Кедровке, Кедровская протока|river:Кедровке; river:Кедровская протока
near||вода у Светлой прибыла|river:Светлой
far||светлая вода; по Светлой тихо|river:светлая
alone||Светлая стоит|
lake||на оз. Налимье тихо|lake:оз. Налимье
word||у Налимья; Чистое и чистого|lake:Налимья; lake:Чистое
post||пост Верхний Луг 12 и пост у Яра|station:Верхний Луг
post-comma||пост Заречный, Дальний|station:Заречный
veto||пост Яр|
old||старый Устье и Устье|station:Устье
case||ГП и гп|office:ГП
winter|season:winter,area:north|на Светлой тонкий лед|river:Светлой
summer|season:winter|на Светлой тонкий лед|
level||Кедровка: 12 м.|river:Кедровка; level:12; unit:м.
flood||разлив Кедровки|hazard:Кедровки
basin||Налимье — Кедровка|basin:Налимье — Кедровка; lake:Налимье; river:Кедровка
guess||пост Журавлихе|station:Журавлихе
empty|||
"""

# Details of spans: document | surface | score | flags | normal forms | types of alternatives
DETAILS = """
near|Светлой|3.50|0|Светлая|
lake|оз. Налимье|8.25|5|Налимье|
word|Налимья|1.75|1|Налимье|
post|Верхний Луг|4.50|8|верхний луг|
level|Кедровка|3.50|0|Кедровка|
level|12|2.00|8|12|
level|м.|3.00|5|метр|
flood|Кедровки|3.00|8|кедровка|river
basin|Налимье — Кедровка|3.50|0|Налимье Кедровка|
basin|Налимье|2.75|17|Налимье|
guess|Журавлихе|3.00|10|журавлиха|
"""

# Dates: text | context year | year-month-day, * if the year is the context's; empty if none
DATES = """
21 янв.|1884|1884-1-21*
21 генваря 1883|0|1883-1-21
21-го января 1883 года|0|1883-1-21
21.01|1884|1884-1-21*
21.01.1884|0|1884-1-21
21/01/1884 г.|0|1884-1-21
21-01-1884|0|1884-1-21
3 іюня 1790|0|1790-6-3
5 ѳевраля 1801 г|0|1801-2-5
29 февраля 1900|0|
29 февраля 1904|0|1904-2-29
31.02.1884|0|
0.01.1884|0|
21.13.1884|0|
21.01.84|0|
21.01|0|
21 янв|999|
1 мартъ 1850|0|1850-3-1
21 числа|1884|
январь|1884|
"""

# Inflection: (lemma, form, tag) of the base, with ё, and of a host dictionary
INFLECT_BASE = """
уезд|уезд|NOUN,inan,masc sing,nomn
уезд|уезда|NOUN,inan,masc sing,gent
уезд|уезд|NOUN,inan,masc sing,accs
уезд|уезды|NOUN,inan,masc plur,nomn
уезд|уездов|NOUN,inan,masc plur,gent
посёлок|посёлок|NOUN,inan,masc sing,nomn
посёлок|посёлки|NOUN,inan,masc plur,nomn
село|село|NOUN,inan,neut sing,nomn
село|сёла|NOUN,inan,neut plur,nomn
село|сёл|NOUN,inan,neut plur,gent
сесть|сесть|INFN,perf,intr
сесть|село|VERB,perf,intr neut,sing,past,indc
сесть|сели|VERB,perf,intr plur,past,indc
"""
INFLECT_CUSTOM = """
посёлок|посёлок|NOUN,inan,masc sing,nomn
посёлок|посёлки|NOUN,inan,masc plur,nomn
"""
# word | kinds | from | want | forms
INFLECT_CASES = """
уезд||NOUN nomn sing|plur nomn|уезды
уезд||NOUN nomn sing|gent plur|уездов
уездов||gent|nomn sing|уезд
Уезд||NOUN nomn sing|plur nomn|уезды
село|||plur|сёла сёл сели
село||NOUN|plur|сёла сёл
село||VERB|plur|сели
уезда||gent||уезда уезд уездов уезды
поселок|base|NOUN nomn sing|plur nomn|посёлки
посёлок|custom|NOUN nomn sing|plur nomn|поселки
посёлок||NOUN nomn sing|plur nomn|посёлки поселки
уезд|custom|NOUN nomn sing|plur nomn|
уезд||NOUN nomn sing|datv|
уездик|||plur|
"""


def rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip("\n").split("\n")]
