"""Word lists that define the behaviour of the text functions, by kind."""

from __future__ import annotations

PRONOUNS = "i me my myself we us our ours you your yours he him his she her hers it its they them their theirs who whom what which this that these those some one"
AUXILIARIES = "am is are was were be been being do does did doing don have has had having can could will would should ought let"
PLACES = "of at by for with about against between into through during before after above below to from up down in out on off over under until back"
JOINING = "and but or if because as while than so nor not no a an the"
ADVERBS = "again further then once here there when where why how all any both each few more most other such only own same too very just now also still even much really well"
TALK = "say said tell told get got go going know like think want yes yeah ok okay else"
REMNANTS = "s t"
STOPWORDS = " ".join((PRONOUNS, AUXILIARIES, PLACES, JOINING, ADVERBS, TALK, REMNANTS)).split()

GREETINGS = "hi hey hello thanks thank please sorry sure great good right"
TIMES = "today yesterday tomorrow sometimes recently first last next finally"
HEDGES = "maybe anyway actually honestly everyone someone everything nothing"
SENTENCE_STARTERS = " ".join((GREETINGS, TIMES, HEDGES)).split()

#: First words that refer to what was said before.
ANAPHORA = "he she they it this that these those same yes yeah no".split()

#: Lower-case words inside a name.
NAME_LINKS = "of the and de da di van von la le".split()

MONTHS = "January February March April May June July August September October November December".split()
SHORT_MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
