"""One text that each rule must find something in, with the place of its first finding marked, and one near miss that it must leave.

The expected places stand in the texts themselves, written by hand; nothing here is computed from the rules.
"""

from __future__ import annotations

_FLAT = "The red fox ran home now. "

#: (rule, style, a text with «the first finding» marked, a text without one).
CASES: list[tuple[str, str, str, str]] = [
    # A
    ("overused-word", "microsoft", "We «delve» and delve again.", "We delve once into this long plain text about nothing much at all."),
    ("marketing-buzzword", "microsoft", "It is a «turnkey» product.", "It is a turnkeys product."),
    ("cliche-opener", "microsoft", "«When it comes to» food, eat.", "She says when it comes to food, eat."),
    ("filler-phrase", "microsoft", "«Needless to say», it works.", "Needless to mention, it works."),
    ("manufactured-contrast", "microsoft", "It is «not just a tool but» a way.", "It is just a tool but a way."),
    ("conclusion-restate", "microsoft", "«In conclusion», it works.", "We say in conclusion, it works."),
    ("vague-attribution", "microsoft", "«Studies show» that it works.", "Studies show that it works [1](x.md)."),
    ("despite-challenges-closer", "microsoft", "«Despite these challenges, it continues to thrive».", "Despite these rains, it continues to thrive."),
    ("significance-boilerplate", "microsoft", "It «stands as a testament» to work.", "It stands as a monument to work."),
    ("em-dash-overuse", "microsoft", "A «—» b — c — d.", "A — b — c."),
    ("bold-lead-in-list", "microsoft", "- «**»One**: a\n- **Two**: b\n- **Three**: c", "- **One**: a\n- **Two**: b\n- Three: c"),
    ("assistant-meta", "microsoft", "Now «I hope this helps» you.", "Now I hope it helps you."),
    ("sycophancy", "microsoft", "«Great question»! Yes.", "A greater question! Yes."),
    ("hedge-overuse", "microsoft", "It «tends to» be arguably so.", "It tends to be so."),
    ("conversational-scaffolding", "microsoft", "Well, «let's explore» this.", "Well, let's go this way."),
    ("superficial-ing-participle", "microsoft", "It grew«, highlighting» a, ensuring b, it, ensuring c.", "It grew, highlighting a need."),
    ("transition-scaffolding", "microsoft", "«Additionally», a.\n\nMoreover, b.", "Additionally, a.\n\nAnd moreover, b."),
    ("excessive-bold", "microsoft", "«**a**» **b** **c** **d**", "**a** **b** **c** d"),
    ("listicle-reflex", "microsoft", "«-» a\n- b\n- c\n- d\n- e", "- a\n- b\n- c\n- d"),
    ("emphasis-as-heading", "microsoft", "«**Some bold line**»\n\nText.", "**Some bold line.**\n\nText."),
    ("hype-intensifier", "microsoft", "It is «vastly» better.", "It is vast and better."),
    ("semicolon-overuse", "microsoft", "A«;» b; c; d.", "A; b; c."),
    ("emoji-decoration", "microsoft", "- «🚀» Launch", "Launch 🚀"),
    ("smart-quotes", "microsoft", "«“»a” and ‘b’", "“a”"),
    ("unicode-artifact", "microsoft", "a«​»b", "a b"),
    ("negative-parallelism", "microsoft", "It is «speed rather than cost». It is bread rather than cake.", "It is speed rather than cost."),
    ("tricolon-overuse", "microsoft", "Some «red, green, and blue». Old, new, and used. Up, down, and out.", "Red, green, and blue. Old, new, and used."),
    ("serves-as-copula", "microsoft", "It «serves as» a and acts as b.", "It serves as a."),
    ("media-coverage-boilerplate", "microsoft", "It was «featured in» a paper.", "It was a feature in a paper."),
    ("future-outlook-speculation", "microsoft", "It «is poised to» win.", "It is posed to win."),
    ("interrogative-answer", "microsoft", "«The result? Bad.» It is.", "The results were? Bad. It is."),
    ("uniform-cadence", "microsoft", "«»" + _FLAT * 6, _FLAT * 5),
    # B
    ("passive-voice", "microsoft", "The door «was closed by» Ana.", "The door was even then."),
    ("long-sentence", "microsoft", "«" + "word " * 30 + "word.»", "word " * 29 + "word."),
    ("wordy-phrase", "microsoft", "We stop «in order to» rest.", "We stop in borders to rest."),
    ("complex-word", "microsoft", "We «utilize» it.", "We reutilize it."),
    ("nominalization", "microsoft", "They «made a decision» now.", "They made a decisions list now."),
    ("weasel-word", "microsoft", "It is «very» good and really fast.", "It is very good, and that is all that we can say of it."),
    ("redundant-pair", "microsoft", "See «each and every» one.", "See each or every one."),
    ("repeated-word", "microsoft", "It «is is» so.", "I know that that had had."),
    ("there-is-expletive", "microsoft", "«There is a rule that» holds.", "Then there is a rule that holds."),
    ("adverb-overuse", "microsoft", "He «slowly» quickly sadly gladly badly ran.", "He slowly quickly sadly gladly ran."),
    ("undefined-acronym", "microsoft", "The «QXZ» works.", "A thing (QXZ) works. The QXZ works."),
    # C
    ("sentence-case-heading", "microsoft", "# «Getting Started Now»\n\nText.", "# Getting started Now\n\nText."),
    ("heading-end-punctuation", "microsoft", "# «The end.»\n\nText.", "# The end?\n\nText."),
    ("word-swap", "microsoft", "We «leverage» it.", "We leveraged it."),
    ("serial-comma", "microsoft", "He sees «red, green and blue» things.", "Red, green and blue."),
    ("intro-comma", "microsoft", "«Moreover w»e go.", "Moreover, we go."),
    ("use-contractions", "microsoft", "We «do not» go.", "We do nothing."),
    ("second-person", "microsoft", "Then «the user should» wait.", "Then the user waits."),
    ("present-tense", "microsoft", "Then «you will see» it.", "Then you willed it."),
    ("singular-they", "microsoft", "Ask «his or her» friend.", "Ask his or a friend."),
    ("no-please-instructions", "microsoft", "Now «please» wait.", "Now pleased, wait."),
    ("terminology-consistency", "microsoft", "Send an email or an «e-mail».", "Send an email or an email."),
    ("acronym-case", "microsoft", "The TLA and the «tla».", "The TLA and the TLA."),
    ("acronym-plural", "microsoft", "Many «TLA's» here.", "Many TLAs here."),
    ("fenced-code-language", "microsoft", "«```»\nx\n```", "```py\nx\n```"),
    ("duplicate-heading", "microsoft", "# A\n\n## b\n\n## «B»", "# A\n\n## B"),
    ("markup-leak", "microsoft", "«#T»itle\n\nText.", "# Title\n\nText."),
    ("inconsistent-capitalization", "microsoft", "The «Big Table» is a big table.", "The Big Table is a big-table."),
    ("malformed-doi-isbn", "microsoft", "See «doi:11.1/x» now.", "See doi:10.1000/x now."),
    ("thematic-break-before-heading", "microsoft", "Text\n\n«---»\n\n# A", "Text\n\n---\n\nA"),
    ("bullet-overuse", "microsoft", "«- a b c d e»\n- b\n- c\n- d\n- e\n- f\n- g\n- h", "- a\n- b\n- c\n- d\n- e\n- f\n- g"),
    ("double-space", "microsoft", "One«  »two.", "One.  Two."),
    ("redundant-acronym", "microsoft", "An «ATM machine» here.", "An ATM here."),
    ("indefinite-article", "microsoft", "It is «a» hour now.", "It is an hour for a user, or a hour."),
    ("placeholder-citation", "microsoft", "So it is «[citation needed]».", "So it is [cited]."),
    ("tracking-param-in-citation", "microsoft", "See [x](https://x.org/«?utm_source=»feed).", "See [x](https://x.org/?source=feed)."),
    ("unused-named-ref", "microsoft", "«[ab]»: https://x.org", "[t][ab]\n\n[ab]: https://x.org"),
    # D
    ("gendered-language", "plain", "The «chairman» met.", "The chair met."),
    ("ableist-language", "microsoft", "It is «crazy».", "It is crazed."),
    ("vague-link-text", "microsoft", "See «[here](a.md)».", "See [the guide](a.md)."),
    ("skipped-heading", "microsoft", "# A\n\n### «B»", "# A\n\n## B"),
    ("person-first-language", "microsoft", "He «suffers from» it.", "He suffers it."),
    ("gendered-address", "microsoft", "Hi «guys», wait.", "Hi guy, wait."),
    ("tech-historical-terms", "microsoft", "Use the «blacklist» now.", "Use the blocklist now."),
    ("violent-tech-metaphor", "microsoft", "Then «kill» it.", "Then kill -9 it."),
    ("ageist-classist-cultural", "microsoft", "A «ghetto» fix.", "A ghettos fix."),
    ("missing-alt-text", "microsoft", "See «![](a.png)» now.", "See ![x](a.png) now."),
    ("all-caps-shouting", "microsoft", "It «IS ALL CAPS» here.", "It IS ALL here."),
    ("bare-url", "microsoft", "See «https://x.org» now.", "See (https://x.org) now."),
    # Microsoft
    ("no-space-em-dash", "microsoft", "A« — »b.", "A—b."),
    ("no-internal-caps", "microsoft", "The «fooBar» thing.", "The iPhone thing."),
    ("omit-you-can", "microsoft", "Here «you can» stop.", "Here you cannot stop."),
    ("avoid-we", "microsoft", "So «we» see our us.", "So we see our."),
    ("spell-out-small-numbers", "microsoft", "Take «5» of them.", "Take 5% of them."),
    ("no-numeral-sentence-start", "microsoft", "«4»2 is it.", "It is 42."),
    ("large-number-grouping", "microsoft", "Send «12345» now.", "Send 1234 now."),
    ("no-k-m-b", "microsoft", "Pay «$5M» now.", "Pay $5 now."),
    ("leading-zero", "microsoft", "Add «.5» more.", "Add 0.5 more."),
    ("microsoft-ampm", "microsoft", "At «5 pm» now.", "At 5 PM now."),
    ("microsoft-accessibility", "microsoft", "An «able-bodied» man.", "A strong man."),
    ("microsoft-auto-hyphenation", "microsoft", "It will «auto-save» it.", "It will autosave it."),
    ("microsoft-avoid-words", "microsoft", "The «backend» is up.", "The backends are up."),
    ("microsoft-contractions", "microsoft", "Now «it is» so.", "Now it was so."),
    ("ms-date-format", "microsoft", "On «31 July 2016» then.", "On July 31, 2016 then."),
    ("ms-date-numbers", "microsoft", "On «July first» then.", "On July 1 then."),
    ("ms-date-order", "microsoft", "On «3/4/2024» then.", "On 3/4 then."),
    ("ms-ellipses", "microsoft", "Wait«...» now.", "Wait.. now."),
    ("ms-first-person", "microsoft", "So «I» see my car.", "So I see a car."),
    ("ms-foreign-abbrev", "microsoft", "Some, «e.g.» this.", "Some, eg: this."),
    ("ms-gender-slash", "microsoft", "Ask if «he/she» can.", "Ask if he can."),
    ("ms-gender-bias", "microsoft", "An «alumnus» came.", "A graduate came."),
    ("microsoft-general-url", "microsoft", "The «URL» is new.", "The url is new."),
    ("microsoft-heading-acronyms", "microsoft", "# The «TLA» page\n\nText.", "# The tla page\n\nText."),
    ("microsoft-heading-colons", "microsoft", "# Page«: o»ne\n\nText.", "# Page: One\n\nText."),
    ("ms-adverb-hyphen", "microsoft", "A «newly-made» thing.", "A family-owned thing."),
    ("ms-negative-number-endash", "microsoft", "It is «-5» now.", "It is x-5 now."),
    ("ms-ordinal-ly", "microsoft", "So «firstly», go.", "So first, go."),
    ("ms-percentages", "microsoft", "Some «five percent» more.", "Some 5 percent more."),
    ("ms-plurals-parenthetical", "microsoft", "The «file(s)» here.", "The file (s) here."),
    ("microsoft-quotes-punctuation", "microsoft", "He said «“yes”,» then.", "He said “yes,” then."),
    ("microsoft-range-time", "microsoft", "From «5 PM–6 PM» on.", "From 5 PM to 6 PM on."),
    ("microsoft-semicolon", "microsoft", "A«;» b.", "A &amp; b."),
    ("ms-suspended-hyphen", "microsoft", "A «first- and second-class» car.", "A first and second-class car."),
    ("ms-term-swaps", "microsoft", "An «adaptor» here.", "An adapter here."),
    ("ms-url-of", "microsoft", "The «URL for» it.", "The URL of it."),
    ("ms-units-spelled-number", "microsoft", "Some «five meters» more.", "Some 5 meters more."),
    ("ms-vocab-az-wordlist", "microsoft", "The text «above» is against it.", "The text above is for it."),
    ("ms-wordiness", "microsoft", "A «sufficient number of» cars.", "A sufficient amount of cars."),
    ("microsoft-adverbs", "microsoft", "He «boldly» and bravely went.", "He boldly went."),
    # Google
    ("no-gerund-heading", "google", "# «Getting it»\n\nText.", "# Get it\n\nText."),
    ("no-link-in-heading", "google", "# «The [x](y.md)»\n\nText.", "# The [x]\n\nText."),
    ("latinism-abbreviation", "google", "Some, «e.g.» this.", "Some, as this."),
    ("minimizing-words", "google", "It is «easy» now.", "It is easier now."),
    ("no-abbreviation-as-verb", "google", "Now «ssh into» it.", "Now use ssh to go."),
    ("no-periods-in-acronyms", "google", "The «U.S.A.» is.", "The USA is."),
    ("no-exclamation", "google", "Go«!» now.", "Go != now."),
    ("american-spelling", "google", "The «colour» is.", "The color is."),
    ("no-preannounce", "google", "It is «currently» so.", "It is current so."),
    ("no-directional", "google", "See «above» for it.", "See over there."),
    ("google-ampm", "google", "At «5pm» now.", "At 5 PM now."),
    ("google-contractions", "google", "Now «it is» so.", "Now it was so."),
    ("google-date-format", "google", "On «31.07.2016» then.", "On July 31, 2016 then."),
    ("google-ellipses", "google", "Wait«...» now.", "Wait… now."),
    ("google-dash-spacing", "google", "A« – »b.", "A–b."),
    ("google-first-person", "google", "So «I» see my car.", "So I see a car."),
    ("google-gender-neutral-pronoun", "google", "Ask if «s/he» can.", "Ask if she can."),
    ("google-gender-bias", "google", "All «mankind» came.", "All people came."),
    ("google-ly-hyphen", "google", "A «newly-made» thing.", "A family-owned thing."),
    ("google-optional-plurals", "google", "The «file(s)» here.", "The box(es) here."),
    ("google-ordinal", "google", "The «3rd» one.", "The 3 rd one."),
    ("google-quote-punctuation", "google", 'He said «"yes",» then.', 'He said "yes," then.'),
    ("google-number-range-words", "google", "It is «between 5 - 6» now.", "It is 5 - 6 now."),
    ("google-semicolons", "google", "A«;» b.", "A, b."),
    ("google-slang", "google", "So «imo» it is.", "So limo it is."),
    ("google-units-nbsp", "google", "Some «20MB» here.", "Some 20 MB here."),
    ("avoid-first-person-plural", "google", "So «we» see our car.", "So we see a car."),
    ("avoid-will-future-tense", "google", "It «will» go and will stop.", "It will go."),
    ("google-word-list", "google", "A «cell phone» here.", "A phone here."),
    # AP
    ("ap-serial-comma", "ap", "Some red, green«,» and blue.", "Some red, green and blue."),
    ("ap-number-style", "ap", "Take «5» of them.", "Take 15 of them."),
    ("ap-percent", "ap", "Take «15%» now.", "Take 15 percent now."),
    ("ap-time-format", "ap", "At «5 PM» now.", "At 5 p.m. now."),
    ("ap-dollar-style", "ap", "Pay «5 million dollars» now.", "Pay $5 million now."),
    ("ap-over-quantity", "ap", "It is «over 5» now.", "It is over it now."),
    ("ap-toward", "ap", "Go «towards» it.", "Go toward it."),
    ("ap-ampersand", "ap", "Red« & »blue.", "Red&blue."),
    # Chicago
    ("chicago-number-style", "chicago", "Take «15» of them.", "Take 101 of them."),
    ("chicago-directional-s", "chicago", "Go «onwards» now.", "Go onward now."),
    ("chicago-percent-symbol", "chicago", "Take «15%» now.", "Take 15 percent now."),
    ("chicago-em-dash-spacing", "chicago", "A« — »b.", "A—b."),
    ("chicago-ellipsis", "chicago", "Wait«…» now.", "Wait . . . now."),
    ("chicago-united-states-noun", "chicago", "So «the US» is big.", "So the US law is big."),
    ("chicago-ibid", "chicago", "See «ibid.» page 3.", "See page 3."),
    # Plain language
    ("plain-long-sentence", "plain", "«" + "word " * 20 + "word.»", "word " * 19 + "word."),
    ("plain-hidden-verb", "plain", "They «conduct a review» now.", "They conduct reviews now."),
    ("plain-shall", "plain", "Tenants «shall» pay.", "Tenants must pay."),
    ("plain-required-to", "plain", "They «are required to» pay.", "They must pay."),
    ("plain-legalese-phrase", "plain", "It is «pursuant to» rule 3.", "It is under rule 3."),
    ("plain-legalese-word", "plain", "It is «herein» said.", "It is said here."),
    ("plain-double-negative", "plain", "It is «not uncommon» here.", "It is not common here."),
    ("reading-grade", "plain", "«Institutional organizational considerations necessitate comprehensive multidisci»" + "plinary administrative reorganization. " + "Institutional organizational considerations necessitate comprehensive administrative reorganization. " * 4, "The cat sat on the mat. " * 8),
]


def texts() -> list[tuple[int, str, str, str, str]]:
    """(id, style, rule, kind, text): finds without their marks, and misses."""
    out = []
    for i, (rule, style, marked, miss) in enumerate(CASES):
        out += [(2 * i, style, rule, "find", marked.replace("«", "").replace("»", "")), (2 * i + 1, style, rule, "miss", miss)]
    return out


FENCE = "~" * 12  #: around a document that follows a text
#: Rules that count a share of all lines, so that a document behind the text changes what they say of it: they stand alone.
ALONE = ("bullet-overuse",)
#: A sentence at the end of a block takes in the line feed that a document behind it adds.
LINE_FEED = ("long-sentence", "plain-long-sentence")


def cases_sql() -> str:
    """A row a text, alone and for each document that follows it: the marked place of a find in bytes, nothing for a miss."""
    quoted = lambda t: t.replace("'", "''")
    rows = ",\n".join(f"({i}, '{r}', '{s}', '{quoted(m)}')" for i, (r, s, m, _) in enumerate(CASES))
    return f"""WITH c(i, rule_id, style, marked) AS (VALUES {rows}), p AS (SELECT i, rule_id, style, strlen(split_part(marked, '«', 1)) AS before, strlen(split_part(split_part(marked, '«', 2), '»', 1)) AS inside FROM c),
k AS (SELECT 2 * i AS number, rule_id, style, 'find' AS kind, CAST(before AS INTEGER) AS "offset", CAST(inside AS INTEGER) AS length FROM p UNION ALL SELECT 2 * i + 1, rule_id, style, 'miss', NULL, NULL FROM p),
d AS (SELECT doc_id, ((doc_id % {2 * len(CASES)}) + {2 * len(CASES)}) % {2 * len(CASES)} AS number FROM documents UNION ALL SELECT -1 - number, number FROM k)
SELECT doc_id, rule_id, style, kind, "offset", CAST(CASE WHEN doc_id >= 0 AND rule_id IN {LINE_FEED} THEN length + 1 ELSE length END AS INTEGER) AS length FROM d JOIN k USING (number) WHERE doc_id < 0 OR rule_id NOT IN ('{ALONE[0]}')"""
