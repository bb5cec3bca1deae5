"""Word lists of the prose rules, by id: kind, family, pack and default entries.

Weighted lists hold (word, base, weight), maps (from, to), groups tuples of variants.
"""

from __future__ import annotations

from typing import Any, NamedTuple


class WordList(NamedTuple):
    kind: str
    family: str
    pack: str | None
    entries: tuple


# Results depend on these very words, weights and replacements.
LISTS: dict[str, WordList] = {
    "overused-word": WordList("weighted", "ai-slop", None, (
        ("delve", "delve", 28.0), ("delves", "delve", 28.0), ("delving", "delve", 28.0), ("delved", "delve", 28.0), ("meticulous", "meticulous", 34.7),
        ("meticulously", "meticulous", 34.7), ("intricate", "intricate", 11.2), ("intricately", "intricate", 11.2), ("commendable", "commendable", 9.8),
        ("commendably", "commendable", 9.8), ("underscore", "underscore", 13.8), ("underscores", "underscore", 13.8), ("underscoring", "underscore", 13.8),
        ("underscored", "underscore", 13.8), ("showcase", "showcase", 10.7), ("showcases", "showcase", 10.7), ("showcasing", "showcase", 10.7), ("showcased", "showcase", 10.7),
        ("realm", "realm", 4.0), ("pivotal", "pivotal", 4.0), ("garner", "garner", 4.0), ("garners", "garner", 4.0), ("garnered", "garner", 4.0), ("boasts", "boast", 4.0),
        ("boast", "boast", 4.0), ("adept", "adept", 4.0), ("groundbreaking", "groundbreaking", 4.0), ("tapestry", "tapestry", 1.5), ("testament", "testament", 1.5),
        ("leverage", "leverage", 1.5), ("leveraging", "leverage", 1.5), ("robust", "robust", 1.5), ("seamless", "seamless", 1.5), ("seamlessly", "seamless", 1.5),
        ("nuanced", "nuanced", 1.5), ("multifaceted", "multifaceted", 1.5), ("potential", "potential", 1.2), ("elevate", "elevate", 1.2), ("elevates", "elevate", 1.2),
        ("elevating", "elevate", 1.2),
    )),
    "marketing-buzzword": WordList("phrases", "ai-slop", None, (
        "streamline", "streamlines", "streamlining", "empower", "empowers", "empowering", "supercharge", "supercharges", "world-class", "enterprise-grade", "cutting-edge",
        "game-changing", "game changer", "game-changer", "next-generation", "next-gen", "best-in-class", "turnkey", "mission-critical", "synergy", "synergies", "holistic",
        "paradigm shift", "frictionless", "bleeding-edge", "unparalleled", "unrivaled", "state-of-the-art", "unlock the full potential", "unlocks the full potential",
        "unlock the power", "harness the power", "harnessing the power",
    )),
    "cliche-opener": WordList("phrases", "ai-slop", None, (
        "in today's fast-paced world", "in today's fast-paced age", "in today's modern world", "in today's modern age", "in today's digital world", "in today's digital age",
        "in today’s fast-paced world", "in today’s fast-paced age", "in today’s modern world", "in today’s modern age", "in today’s digital world", "in today’s digital age",
        "in the ever-evolving landscape of", "in the ever-evolving world of", "in the ever-changing landscape of", "in the ever-changing world of",
        "in the rapidly changing landscape of", "in the rapidly changing world of", "in the realm of", "in the digital age", "in an era of", "in an age of", "when it comes to",
        "at its core", "in the world of",
    )),
    "significance-boilerplate": WordList("phrases", "ai-slop", None, (
        "stands as a testament", "marking a pivotal moment", "leaving an indelible mark", "enduring legacy", "key turning point", "plays a vital role", "plays a crucial role",
        "plays a pivotal role", "plays a key role", "plays a significant role", "rich history", "rich tapestry", "rich tradition", "navigating the complexities of",
        "navigate the complexities of", "navigating the complex landscape of",
    )),
    "sycophancy": WordList("phrases", "ai-slop", None, (
        "Great question", "You're absolutely right", "That's a great point", "Excellent question", "What a fascinating",
    )),
    "hedge-overuse": WordList("phrases", "ai-slop", None, (
        "it could be argued", "arguably", "to some extent", "in many ways", "in some ways", "more often than not", "generally speaking", "broadly speaking", "in a sense",
        "for all intents and purposes", "tends to", "somewhat", "sort of", "kind of",
    )),
    "conversational-scaffolding": WordList("phrases", "ai-slop", None, (
        "let's delve into", "let's break this down", "let's dive in", "let's explore", "let's unpack", "deep dive into", "take a deep dive", "think of it as", "think of it like",
        "imagine a world where", "to put it simply", "here's the kicker", "here's the thing", "buckle up", "spoiler alert", "plot twist",
    )),
    "hype-intensifier": WordList("phrases", "ai-slop", None, (
        "greatly", "vastly", "hugely", "immensely", "enormously", "tremendously", "remarkably", "crucial", "crucially", "pivotal", "paramount", "invaluable", "one of the most",
        "a great deal of",
    )),
    "serves-as-copula": WordList("phrases", "ai-slop", None, (
        "serves as", "serve as", "stands as", "stand as", "acts as", "functions as", "represents a", "exemplifies", "embodies",
    )),
    "media-coverage-boilerplate": WordList("phrases", "ai-slop", None, (
        "featured in", "profiled in", "has been featured", "and other prominent outlets", "maintains a strong", "a strong social media presence", "an active digital presence",
        "garnered attention",
    )),
    "future-outlook-speculation": WordList("phrases", "ai-slop", None, (
        "the future of", "evolving landscape", "continues to evolve", "is poised to", "on the horizon", "in the years to come", "only time will tell", "the road ahead",
    )),
    "conclusion-restate": WordList("words", "ai-slop", None, (
        "In conclusion", "In summary", "To sum up", "In essence", "Overall", "Ultimately", "All in all",
    )),
    "transition-scaffolding": WordList("words", "ai-slop", None, (
        "Additionally", "Moreover", "Furthermore", "However", "Consequently", "Nevertheless",
    )),
    "wordy-phrase": WordList("map", "clarity", None, (
        ("in order to", "to"), ("due to the fact that", "because"), ("at this point in time", "now"), ("at the present time", "now"), ("in the event that", "if"),
        ("in spite of the fact that", "although"), ("with regard to", "about"), ("with respect to", "about"), ("for the purpose of", "to"), ("has the ability to", "can"),
        ("have the ability to", "can"), ("a number of", "some"), ("a majority of", "most"), ("in the near future", "soon"), ("on a regular basis", "regularly"),
        ("in close proximity to", "near"), ("take into consideration", "consider"),
    )),
    "complex-word": WordList("map", "clarity", None, (
        ("utilize", "use"), ("utilizes", "use"), ("utilizing", "using"), ("utilization", "use"), ("facilitate", "help"), ("facilitates", "helps"), ("commence", "start"),
        ("commences", "starts"), ("endeavor", "try"), ("ascertain", "find out"), ("numerous", "many"), ("sufficient", "enough"), ("methodology", "method"), ("additional", "more"),
        ("approximately", "about"), ("demonstrate", "show"), ("demonstrates", "shows"), ("individuals", "people"), ("subsequently", "later"), ("prior", "before"),
        ("initiate", "start"), ("terminate", "end"), ("component", "part"), ("functionality", "features"),
    )),
    "nominalization": WordList("map", "clarity", None, (
        ("make a decision", "decide"), ("made a decision", "decided"), ("conduct an investigation", "investigate"), ("provide assistance", "assist"),
        ("give consideration to", "consider"), ("reach a conclusion", "conclude"), ("perform an analysis", "analyze"), ("make an assumption", "assume"),
        ("come to an agreement", "agree"), ("take action", "act"), ("make a contribution", "contribute"), ("provide a description", "describe"), ("make an improvement", "improve"),
    )),
    "weasel-word": WordList("words", "clarity", None, (
        "very", "really", "quite", "fairly", "rather", "somewhat", "just", "basically", "actually", "simply", "literally", "extremely", "incredibly", "totally",
    )),
    "redundant-pair": WordList("phrases", "clarity", None, (
        "each and every", "first and foremost", "end result", "free gift", "past history", "future plans", "various different", "absolutely essential", "advance planning",
        "close proximity", "basic fundamentals", "completely eliminate", "final outcome", "unexpected surprise", "added bonus", "new innovation", "true fact",
    )),
    "style-swap": WordList("map", "style", None, (
        ("leverage", "use"), ("e.g.", "for example"), ("i.e.", "that is"), ("etc", "and so on"), ("execute", "run"), ("grayed out", "unavailable"), ("and/or", "or"),
        ("deselect", "clear"), ("login", "sign in (verb)"), ("log in", "sign in"), ("e-mail", "email"), ("check box", "checkbox"), ("drop-down", "dropdown"),
    )),
    "contraction": WordList("map", "style", None, (
        ("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"), ("were not", "weren't"),
        ("cannot", "can't"), ("can not", "can't"), ("will not", "won't"), ("would not", "wouldn't"), ("should not", "shouldn't"), ("could not", "couldn't"),
        ("have not", "haven't"), ("has not", "hasn't"),
    )),
    "singular-they": WordList("map", "style", None, (
        ("he or she", "they"), ("she or he", "they"), ("his or her", "their"), ("her or his", "their"), ("him or her", "them"), ("he/she", "they"), ("(s)he", "they"),
        ("s/he", "they"), ("his/her", "their"),
    )),
    "redundant-acronym": WordList("phrases", "style", None, (
        "ATM machine", "PIN number", "LCD display", "HIV virus", "RAM memory", "PDF format", "ISBN number", "GPS system", "CPU unit", "UPC code", "NIC card", "please RSVP",
        "HTTP protocol", "IP protocol", "SIN number", "VIN number",
    )),
    "terminology-consistency": WordList("groups", "style", None, (
        ("sign in", "log in", "login"), ("email", "e-mail"), ("dropdown", "drop-down"), ("website", "web site"), ("checkbox", "check box"), ("filename", "file name"),
        ("setup", "set-up"), ("username", "user name"),
    )),
    "gendered-noun": WordList("map", "inclusive", None, (
        ("chairman", "chair"), ("chairmen", "chairs"), ("mankind", "humanity"), ("manpower", "workforce"), ("man-hours", "person-hours"), ("manned", "staffed"),
        ("salesman", "salesperson"), ("salesmen", "salespeople"), ("policeman", "police officer"), ("policemen", "police officers"), ("layman", "layperson"),
        ("laymen", "laypeople"), ("freshman", "first-year student"), ("fireman", "firefighter"), ("firemen", "firefighters"), ("stewardess", "flight attendant"),
        ("mailman", "mail carrier"), ("businessman", "businessperson"), ("man-made", "artificial"),
    )),
    "ableist-term": WordList("map", "inclusive", None, (
        ("crazy", "wild / baffling"), ("insane", "extreme"), ("psycho", "erratic"), ("lame", "weak"), ("dumb", "foolish"), ("tone-deaf", "insensitive"), ("cripple", "degrade"),
        ("cripples", "degrades"), ("crippling", "degrading"),
    )),
    "ableist-term-advisory": WordList("map", "inclusive", None, (
        ("sanity check", "consistency check"), ("sane", "reasonable"), ("dummy value", "placeholder value"),
    )),
    "vague-link-text": WordList("words", "inclusive", None, (
        "click here", "here", "read more", "this", "this link", "link", "more",
    )),
    "person-first": WordList("map", "inclusive", None, (
        ("suffers from", "has"), ("suffering from", "living with"), ("victim of", "person affected by"), ("wheelchair-bound", "wheelchair user"),
        ("confined to a wheelchair", "uses a wheelchair"), ("an epileptic", "a person with epilepsy"), ("the disabled", "disabled people"),
        ("the mentally ill", "people with mental illness"), ("normal people", "people without disabilities"),
    )),
    "tech-inclusive": WordList("map", "inclusive", None, (
        ("blacklist", "blocklist"), ("blacklists", "blocklists"), ("blacklisted", "blocked"), ("whitelist", "allowlist"), ("whitelists", "allowlists"), ("whitelisted", "allowed"),
        ("master/slave", "primary/replica"), ("grandfathered", "legacy"), ("grandfather", "legacy"), ("blackhat", "unethical"), ("whitehat", "ethical"),
        ("first-class citizen", "fully supported"), ("sanity", "confidence"),
    )),
    "tech-inclusive-advisory": WordList("map", "inclusive", None, (
        ("master", "primary / main"), ("slave", "replica / worker"), ("native", "built-in"), ("primitive", "basic"), ("tribe", "team"),
    )),
    "violent-metaphor": WordList("map", "inclusive", None, (
        ("abort", "stop"), ("aborts", "stops"), ("kill", "end"), ("killing", "ending"), ("hang", "stop responding"), ("hangs", "stops responding"),
        ("blast radius", "scope of impact"), ("dmz", "perimeter network"),
    )),
    "dated-term": WordList("map", "inclusive", None, (
        ("ghetto", "makeshift"), ("gypsy", "traveler"), ("gypped", "cheated"), ("oriental", "Asian"), ("eskimo", "Inuit"), ("third-world", "developing"),
        ("third world", "developing"), ("the elderly", "older adults"), ("illegal immigrant", "undocumented immigrant"), ("illegal alien", "undocumented immigrant"),
        ("sketchy", "questionable"),
    )),
    "microsoft-accessibility": WordList("phrases", "inclusive", 'microsoft', (
        "a victim of", "able-bodied", "an epileptic", "birth defect", "crippled", "differently abled", "disabled", "dumb", "handicapped", "handicaps", "healthy person",
        "hearing-impaired", "lame", "maimed", "mentally handicapped", "missing a limb", "mute", "non-verbal", "normal person", "sight-impaired", "slow learner", "stricken with",
        "suffers from", "vision-impaired",
    )),
    "microsoft-gender-bias": WordList("map", "inclusive", 'microsoft', (
        ("alumna", "graduate"), ("alumnus", "graduate"), ("alumnae", "graduates"), ("alumni", "graduates"), ("airman", "pilot(s)"), ("airmen", "pilot(s)"),
        ("airwoman", "pilot(s)"), ("airwomen", "pilot(s)"), ("anchorman", "anchor(s)"), ("anchormen", "anchor(s)"), ("anchorwoman", "anchor(s)"), ("anchorwomen", "anchor(s)"),
        ("authoress", "author"), ("cameraman", "camera operator(s)"), ("cameramen", "camera operator(s)"), ("camerawoman", "camera operator(s)"),
        ("camerawomen", "camera operator(s)"), ("doorman", "concierge(s)"), ("doormen", "concierge(s)"), ("doorwoman", "concierge(s)"), ("doorwomen", "concierge(s)"),
        ("draftsman", "drafter(s)"), ("draftsmen", "drafter(s)"), ("draftswoman", "drafter(s)"), ("draftswomen", "drafter(s)"), ("fireman", "firefighter(s)"),
        ("firemen", "firefighter(s)"), ("firewoman", "firefighter(s)"), ("firewomen", "firefighter(s)"), ("fisherman", "fisher(s)"), ("fishermen", "fisher(s)"),
        ("fisherwoman", "fisher(s)"), ("fisherwomen", "fisher(s)"), ("freshman", "first-year student(s)"), ("freshmen", "first-year student(s)"),
        ("freshwoman", "first-year student(s)"), ("freshwomen", "first-year student(s)"), ("garbageman", "waste collector(s)"), ("garbagemen", "waste collector(s)"),
        ("garbagewoman", "waste collector(s)"), ("garbagewomen", "waste collector(s)"), ("lady lawyer", "lawyer"), ("ladylike", "courteous"), ("mailman", "mail carriers"),
        ("mailmen", "mail carriers"), ("mailwoman", "mail carriers"), ("mailwomen", "mail carriers"), ("man and wife", "husband and wife"), ("man enough", "strong enough"),
        ("mankind", "human kind"), ("manmade", "manufactured"), ("manpower", "personnel"), ("middleman", "intermediary"), ("middlemen", "intermediary"),
        ("middlewoman", "intermediary"), ("middlewomen", "intermediary"), ("newsman", "journalist(s)"), ("newsmen", "journalist(s)"), ("newswoman", "journalist(s)"),
        ("newswomen", "journalist(s)"), ("ombudsman", "ombuds"), ("ombudsmen", "ombuds"), ("ombudswoman", "ombuds"), ("ombudswomen", "ombuds"), ("oneupmanship", "upstaging"),
        ("poetess", "poet"), ("policeman", "police officer(s)"), ("policemen", "police officer(s)"), ("policewoman", "police officer(s)"), ("policewomen", "police officer(s)"),
        ("repairman", "technician(s)"), ("repairmen", "technician(s)"), ("repairwoman", "technician(s)"), ("repairwomen", "technician(s)"),
        ("salesman", "salesperson or sales people"), ("salesmen", "salesperson or sales people"), ("saleswoman", "salesperson or sales people"),
        ("saleswomen", "salesperson or sales people"), ("serviceman", "soldier(s)"), ("servicemen", "soldier(s)"), ("servicewoman", "soldier(s)"), ("servicewomen", "soldier(s)"),
        ("steward", "flight attendant"), ("stewardess", "flight attendant"), ("tribesman", "tribe member(s)"), ("tribesmen", "tribe member(s)"), ("tribeswoman", "tribe member(s)"),
        ("tribeswomen", "tribe member(s)"), ("waitress", "waiter"), ("woman doctor", "doctor"), ("woman scientist", "scientist(s)"), ("woman scientists", "scientist(s)"),
        ("workman", "worker(s)"), ("workmen", "worker(s)"), ("workwoman", "worker(s)"), ("workwomen", "worker(s)"),
    )),
    "microsoft-contractions": WordList("map", "style", 'microsoft', (
        ("how is", "how's"), ("it is", "it's"), ("that is", "that's"), ("they are", "they're"), ("we are", "we're"), ("we have", "we've"), ("what is", "what's"),
        ("when is", "when's"), ("where is", "where's"),
    )),
    "microsoft-term-swap": WordList("map", "style", 'microsoft', (
        ("adaptor", "adapter"), ("administrate", "administer"), ("alphanumerical", "alphanumeric"), ("an url", "a URL"), ("anti-aliasing", "antialiasing"),
        ("anti-malware", "antimalware"), ("anti-spyware", "antispyware"), ("anti-virus", "antivirus"), ("appendixes", "appendices"), ("afterwards", "afterward"),
        ("keypress", "keystroke"), ("conversation-as-a-platform", "conversation as a platform"), ("audio-book", "audiobook"), ("audio book", "audiobook"),
        ("back-light", "backlight"), ("smart phone", "phone"), ("smartphone", "phone"), ("mobile phone", "phone"), ("24/7", "every day"), ("web robot", "bot"),
        ("internet bot", "bot"), ("machine language", "assembly language"), ("virtual assistant", "personal digital assistant"),
        ("intelligent personal assistant", "personal digital assistant"), ("chat bot", "chatbot"), ("chat bots", "chatbot"), ("chatbots", "chatbot"),
    )),
    "microsoft-wordiness": WordList("map", "clarity", 'microsoft', (
        ("sufficient number of", "enough"), ("sufficient number", "enough"), ("take away", "remove"), ("eliminate", "remove"), ("as a means to", "to"), ("as a means of", "to"),
        ("in an effort to", "to"), ("inform", "tell"), ("let me know", "tell"), ("previous to", "before"), ("prior to", "before"), ("utilize", "use"), ("make use of", "use"),
        ("a large majority of", "most"), ("a majority of", "most"), ("a large number of", "many"), ("a number of", "many"), ("a myriad of", "myriad"), ("adversely impact", "hurt"),
        ("all across", "across"), ("all of a sudden", "suddenly"), ("all of these", "these"), ("all of", "all"), ("all-time record", "record"), ("almost all", "most"),
        ("almost never", "seldom"), ("along the lines of", "similar to"), ("an adequate number of", "enough"), ("an appreciable number of", "many"), ("an estimated", "about"),
        ("any and all", "all"), ("are in agreement", "agree"), ("as a matter of fact", "in fact"), ("as a result of", "because of"), ("as of yet", "yet"), ("as per", "per"),
        ("at a later date", "later"), ("at all times", "always"), ("at the present time", "now"), ("at this point in time", "at this point"),
        ("based in large part on", "based on"), ("based on the fact that", "because"), ("basic necessity", "necessity"), ("because of the fact that", "because"),
        ("came to a realization", "realized"), ("came to an abrupt end", "ended abruptly"), ("carry out an evaluation of", "evaluate"), ("close down", "close"),
        ("closed down", "closed"), ("complete stranger", "stranger"), ("completely separate", "separate"), ("concerning the matter of", "regarding"),
        ("conduct a review of", "review"), ("conduct an investigation", "investigate"), ("conduct experiments", "experiment"), ("continue on", "continue"),
        ("despite the fact that", "although"), ("disappear from sight", "disappear"), ("doomed to fail", "doomed"), ("drag and drop", "drag"), ("drag-and-drop", "drag"),
        ("due to the fact that", "because"), ("during the period of", "during"), ("during the time that", "while"), ("emergency situation", "emergency"),
        ("establish connectivity", "connect"), ("except when", "unless"), ("excessive number", "too many"), ("extend an invitation", "invite"), ("fall down", "fall"),
        ("fell down", "fell"), ("for the duration of", "during"), ("gather together", "gather"), ("has the ability to", "can"), ("has the capacity to", "can"),
        ("has the opportunity to", "could"), ("hold a meeting", "meet"), ("if this is not the case", "if not"), ("in a careful manner", "carefully"),
        ("in a thoughtful manner", "thoughtfully"), ("in a timely manner", "timely"), ("in addition", "also"), ("in between", "between"), ("in lieu of", "instead of"),
        ("in many cases", "often"), ("in most cases", "usually"), ("in some cases", "sometimes"), ("in spite of the fact that", "although"), ("in spite of", "despite"),
        ("in the very near future", "soon"), ("in the near future", "soon"), ("in the event that", "if"), ("in the neighborhood of", "roughly"), ("in the vicinity of", "close to"),
        ("it would appear that", "apparently"), ("lift up", "lift"), ("made reference to", "referred to"), ("make reference to", "refer to"), ("mix together", "mix"),
        ("none at all", "none"), ("not in a position to", "unable"), ("not possible", "impossible"), ("of major importance", "important"), ("perform an assessment of", "assess"),
        ("pertaining to", "about"), ("place an order", "order"), ("plays a key role in", "is essential to"), ("present time", "now"), ("readily apparent", "apparent"),
        ("some of the", "some"), ("span across", "span"), ("subsequent to", "after"), ("successfully complete", "complete"), ("take action", "act"),
        ("take into account", "consider"), ("the question as to whether", "whether"), ("there is no doubt but that", "doubtless"), ("this day and age", "this age"),
        ("this is a subject that", "this subject"), ("time frame", "time"), ("time period", "time"), ("under the provisions of", "under"), ("until such time as", "until"),
        ("used for fuel purposes", "used for fuel"), ("whether or not", "whether"), ("with regard to", "regarding"), ("with the exception of", "except for"),
    )),
    "microsoft-adverbs": WordList("words", "clarity", 'microsoft', (
    )),
    "microsoft-a-z": WordList("words", "style", 'microsoft', (
        "above", "accessible", "actionable", "against", "alarm", "alert", "alias", "allow", "allows", "and/or", "as well as", "assure", "author", "avg", "beta", "ensure", "he",
        "insure", "sample", "she",
    )),
    "google-latinism": WordList("map", "style", 'google', (
        ("e.g.", "for example"), ("i.e.", "that is"), ("etc.", "and so on"), ("etc", "and so on"), ("via", "through"), ("vs.", "versus"), ("vs", "versus"),
    )),
    "google-american-spelling": WordList("map", "style", 'google', (
        ("colour", "color"), ("colours", "colors"), ("favour", "favor"), ("behaviour", "behavior"), ("flavour", "flavor"), ("honour", "honor"), ("labour", "labor"),
        ("neighbour", "neighbor"), ("organise", "organize"), ("organised", "organized"), ("recognise", "recognize"), ("analyse", "analyze"), ("catalogue", "catalog"),
        ("dialogue", "dialog"), ("centre", "center"), ("metre", "meter"), ("licence", "license"), ("defence", "defense"), ("grey", "gray"), ("cancelled", "canceled"),
        ("travelling", "traveling"), ("modelling", "modeling"),
    )),
    "google-directional": WordList("map", "style", 'google', (
        ("above", "preceding"), ("below", "following"),
    )),
    "google-word-swap": WordList("map", "style", 'google', (
        ("dev key", "API key"), ("developer key", "API key"), ("api console key", "API key"), ("cellphone", "phone"), ("cell phone", "phone"), ("smartphone", "phone"),
        ("smart phone", "phone"), ("dev console", "API console"), ("developer console", "API console"), ("apis console", "API console"), ("e-mail", "email"), ("filepath", "path"),
        ("file path", "path"), ("pathname", "path"), ("path name", "path"), ("oauth2", "OAuth 2.0"), ("wifi", "Wi-Fi"), ("google i-o", "Google I/O"), ("google io", "Google I/O"),
        ("tap and hold", "touch & hold"), ("long press", "touch & hold"), ("uncheck", "clear"), ("unselect", "clear"), ("account name", "username"), ("action bar", "app bar"),
        ("ajax", "AJAX"), ("authn", "authentication"), ("authz", "authorization"), ("autoupdate", "automatically update"), ("cellular data", "mobile data"),
        ("cellular network", "mobile network"), ("check box", "checkbox"), ("click on", "click"), ("container engine", "Kubernetes Engine"), ("content type", "media type"),
        ("curated roles", "predefined roles"), ("data are", "data is"), ("file name", "filename"), ("k8s", "Kubernetes"), ("network ip address", "internal IP address"),
        ("omnibox", "address bar"), ("sign into", "sign in to"), ("stylesheet", "style sheet"), ("tablename", "table name"), ("vs.", "versus"), ("world wide web", "web"),
        ("approx.", "approximately"),
    )),
    "google-minimizing": WordList("words", "clarity", 'google', (
        "easy", "easily", "simple", "simply", "just", "quick", "quickly", "obviously", "of course", "merely", "trivial",
    )),
    "google-preannounce": WordList("phrases", "style", 'google', (
        "currently", "presently", "at this time", "latest", "newest", "brand-new", "soon", "in the near future", "upcoming",
    )),
    "plain-hidden-verb": WordList("map", "clarity", 'plain', (
        ("make a determination", "determine"), ("provide an explanation", "explain"), ("conduct a review", "review"), ("perform a calculation", "calculate"),
        ("give authorization", "authorize"), ("make a recommendation", "recommend"), ("reach a decision", "decide"), ("make use of", "use"), ("make reference to", "refer to"),
        ("provide notification", "notify"), ("make an adjustment", "adjust"), ("is in violation of", "violates"),
    )),
    "plain-required-to": WordList("map", "clarity", 'plain', (
        ("is required to", "must"), ("are required to", "must"), ("will be required to", "must"),
    )),
    "plain-legalese-phrase": WordList("map", "clarity", 'plain', (
        ("pursuant to", "under"), ("in accordance with", "under"), ("prior to", "before"),
    )),
    "plain-legalese-word": WordList("words", "clarity", 'plain', (
        "herein", "thereof", "aforementioned", "heretofore", "notwithstanding", "hereinafter",
    )),
}
