"""Word lists, lookup tables and patterns that results depend on."""

#: Abbreviations of reports and what they stand for, in the order in which they are expanded.
ABBREVIATIONS = [
    (r"\bR\s*/\s*Os\b", "Reporting Officers"),
    (r"\bR\s*/\s*O\b", "Reporting Officer"),
    (r"\bR\s*/\s*Is\b", "Reporting Investigators"),
    (r"\bR\s*/\s*I\b", "Reporting Investigator"),
    (r"\bCSU\b", "Crime Scene Unit"),
    (r"\bETA\b", "Estimated Time of Arrival"),
]

#: Patterns of clock times, actors, surroundings, event verbs, markers of segments and dates in running text.
CLOCK = r"(?iu)\b\d{1,2}[:.]\d{2}\s*(?:a\.?\s*m\.?|p\.?\s*m\.?)"
ACTOR = r"(?iu)\b(?:Reporting Officer|Reporting Investigator|Officer|Detective|Inspector|Deputy)s?\b"
SURROUNDINGS = r"(?iu)\b(?:Weather|Temperature|Humidity)\b"
EVENT_VERBS = r"(?iu)\b(?:reported|arrived|observed|pronounced|called|responded|notified|dispatched|assigned|proceeded)\b"
SEGMENT = r"(?iu)(At \d{1,2}:\d{2} (?:a\.m\.|p\.m\.)|Reporting Officer \w+|Reporting Investigator \w+|Inspector \w+|Deputy \w+)"
INLINE_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b"
CALLS_TO_ACTION = r"contact|buy|get|demo|signup|book|start|quote"

#: The same abbreviations as they stand in unified sentences, without space at the slash.
TIGHT_ABBREVIATIONS = [
    (r"\bR/O\b", "Reporting Officer"), (r"\bR/Os\b", "Reporting Officers"), (r"\bR/I\b", "Reporting Investigator"), (r"\bR/Is\b", "Reporting Investigators"), (r"\bCSU\b", "Crime Scene Unit"), (r"\bETA\b", "Estimated Time of Arrival"),
]

#: Clock times in running speech, the day on which bare clock times fall, abbreviations whose stop ends no sentence.
INLINE_CLOCK = r"(?i)\b\d{1,2}:\d{2}\s*(?:a\.m\.|p\.m\.|am|pm)"
INCIDENT_DATE = "2022-10-16"
STOPPED = ["Dr", "Mr", "Mrs", "Ms", "St", "No", "Jr", "Sr", "Lt", "Sgt", "Insp", "Ofc", "Inc", "Ltd", "Co", "vs", "etc", "approx", "a.m", "p.m", "e.g", "i.e"]

#: Pronouns that coreference resolves; those that unification replaces add it and its.
COREF_PRONOUNS = ["he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs"]
PRONOUNS = ["he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "it", "its"]

#: Words that make a phrase a place.
PLACE_WORDS = ["residence", "house", "home", "basement", "stairs", "staircase", "bedroom", "living room", "kitchen", "bathroom", "porch", "gallery", "diner", "big bad breakfast", "the lucky café", "c'est belle"]

#: Labels of entities that take part in events.
PARTICIPANT_LABELS = ["PERSON", "ROLE", "ORG", "EVIDENCE"]
OBJECT_LABELS = ["PERSON", "ORG", "EVIDENCE"]

#: The type of relation that a verb states.
VERB_TYPES = {
    "arrive": "ARRIVED_AT", "secure": "SECURED", "observe": "OBSERVED", "remove": "REMOVED", "pronounce": "PRONOUNCED", "respond": "RESPONDED",
    "identify": "IDENTIFIED", "meet": "MET", "direct": "DIRECTED", "interview": "INTERVIEWED", "examine": "EXAMINED", "report": "CLAIMED",
    "say": "CLAIMED", "indicate": "CLAIMED", "call": "DISPATCHED", "dispatch": "DISPATCHED", "find": "DISCOVERED", "see": "OBSERVED",
    "hear": "HEARD", "tell": "STATED", "ask": "ASKED", "state": "STATED", "believe": "BELIEVED", "know": "KNEW", "witness": "WITNESSED",
    "locate": "LOCATED", "take": "TOOK", "give": "GAVE", "receive": "RECEIVED", "provide": "PROVIDED", "request": "REQUESTED", "confirm": "CONFIRMED",
    "determine": "DETERMINED", "investigate": "INVESTIGATED", "document": "DOCUMENTED", "collect": "COLLECTED", "seize": "SEIZED",
    "transport": "TRANSPORTED", "process": "PROCESSED", "review": "REVIEWED", "note": "NOTED", "discover": "DISCOVERED", "describe": "DESCRIBED",
    "mention": "MENTIONED", "claim": "CLAIMED", "bear": "HAS_PARENT", "sister": "HAS_SIBLING", "marry": "MARRIED_TO", "boyfriend": "PARTNER_OF",
    "work": "WORKS_AT", "teach": "WORKS_AT", "graduate": "STUDIES_AT", "own": "OWNS_BUSINESS", "live": "LIVES_AT", "socialize": "FREQUENTS",
    "notify": "NOTIFIED_ABOUT", "contact": "CONTACTED_ABOUT",
}

#: Forms of the verbs above that no rule gives, and the nouns among them.
IRREGULAR_VERBS = {
    "be": "is was are were been am", "find": "found", "see": "saw seen", "hear": "heard", "tell": "told", "know": "knew known", "take": "took taken", "give": "gave given", "say": "said",
    "meet": "met", "bear": "bore born borne", "teach": "taught",
}
NOUN_PREDICATES = ["sister", "boyfriend"]

#: Types of relation that get an edge of their name, one that gets another, and words of what is owned.
EDGE_TYPES = """ARRIVED_AT SECURED INTERVIEWED EXAMINED RESPONDED DISPATCHED PRONOUNCED MET DIRECTED IDENTIFIED CLAIMED OBSERVED
HAS_PARENT HAS_CHILD HAS_SIBLING PARTNER_OF MARRIED_TO WORKS_AT STUDIES_AT OWNS_BUSINESS REPORTED_TO CONTACTED_ABOUT NOTIFIED_ABOUT LIVES_AT
FREQUENTS DISCOVERED HEARD STATED ASKED BELIEVED KNEW WITNESSED LOCATED TOOK GAVE RECEIVED PROVIDED REQUESTED CONFIRMED DETERMINED
INVESTIGATED DOCUMENTED COLLECTED SEIZED TRANSPORTED PROCESSED REVIEWED NOTED DESCRIBED MENTIONED""".split()
EDGE_OF_TYPE = {"REMOVED": "OBSERVED"}
OWNED = ["dog", "thoreau", "briefcase", "handbag", "residence", "house"]

#: Ends of relations that have a canonical node: (how the phrase is held against the words, words, id; no id: the phrase itself).
ENDPOINT_RULES = [
    ("is", "the scene", "LOC_home"), ("is", "the residence", "LOC_home"), ("is", "the house", "LOC_home"), ("is", "the basement", "LOC_basement"), ("is", "the bedroom", "LOC_bedroom"), ("is", "the gallery", "LOC_gallery"),
    ("is", "the kitchen", "LOC_kitchen"), ("is", "the porch", "LOC_porch"), ("is", "the stairs", "LOC_stairs"),
    ("has", "reporting officer", None), ("has", "reporting investigator", None), ("has", "dog", "ENT_thoreau"), ("has", "thoreau", "ENT_thoreau"),
]
OBJECT_ENDPOINT_RULES = [("has", "body", "ENT_body"), ("has", "handbag", "ENT_handbag"), ("has", "briefcase", "ENT_briefcase")]

#: Phrases of the two gazetteers with their labels; patterns where a token may vary.
RULER = [
    ("Reporting Officer", "ROLE"), ("Reporting Investigator", "ROLE"), ("Crime Scene Unit", "ORG"), ("Coroner's Inspector", "ROLE"), ("Deputy", "ROLE"), ("Animal Control", "ORG"), ("Dispatch", "ORG"), (r"(?i:unit)\s+\d+", "ORG"),
    ("body", "EVIDENCE"), (r"(?i:deceased)\s+(?i:body)", "EVIDENCE"), (r"(?i:human)\s+(?i:remains)", "EVIDENCE"), ("dog", "EVIDENCE"), ("handbag", "EVIDENCE"), ("briefcase", "EVIDENCE"), ("residence", "LOC"), ("victim", "PERSON"),
]
COREF_RULER = [
    ("Reporting Officer", "ROLE"), ("Reporting Investigator", "ROLE"), ("Crime Scene Unit", "ORG"), ("Coroner's Inspector", "ROLE"), ("Deputy", "ROLE"), ("Witness", "PERSON"), ("Victim", "PERSON"), ("Body", "EVIDENCE"), ("Dog", "EVIDENCE"), ("Residence", "LOC"), ("Scene", "LOC"),
]
GAZETTEER = [(p, label) for p, label in RULER if "(?" not in p]

#: Words that make all entities with one of them one entity, in the order of the passes.
UNIQUE_GROUPS = [["victim", "deceased", "body"], ["dog"], ["body"], ["scene"], ["residence"]]

#: Headings of summary sections whose title is not their key in title case.
SECTION_TITLES = {
    "speakers": "Speakers/Participants", "topics_discussed": "Topics Discussed", "key_points": "Key Points", "main_points": "Main Points", "main_themes": "Main Themes", "key_arguments": "Key Arguments",
    "important_facts": "Important Facts", "conclusions": "Conclusions", "decisions": "Decisions Made", "decisions_made": "Decisions Made", "action_items": "Action Items", "next_steps": "Next Steps", "participants": "Participants",
    "agenda_items": "Agenda Items", "main_sections": "Main Sections", "key_findings": "Key Findings", "important_details": "Important Details", "summary_points": "Summary Points", "key_insights": "Key Insights",
    "important_information": "Important Information", "takeaways": "Takeaways", "key_sections": "Key Sections", "highlights": "Highlights", "recommendations": "Recommendations", "error_info": "Error Information",
    "content_stats": "Content Statistics", "suggestions": "Suggestions",
}

#: Sentences of a summary made without a model.
OVERVIEW = "Crawled {pages} page(s) from {root}. LLM output unavailable ({reason}); showing crawler-derived summary."
TEXT_OVERVIEW = "Text analysis unavailable ({reason}). Content length: {size} characters."
TEXT_SECTIONS = {"error_info": "Content could not be analyzed by LLM", "content_stats": "Text length: {size} characters", "suggestions": "Try with different content or check LLM configuration"}

#: The two standing recommendations of a summary made without a model.
RECOMMENDATIONS = [
    "Review the crawler output manually because the LLM blocked the content.",
    "Retry with sanitized text or a different site if you need an AI-authored summary.",
]
