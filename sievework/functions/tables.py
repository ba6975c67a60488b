"""Word tables of the posting domain: skills, regions, CV terms."""

from __future__ import annotations

# They must equal the reference's, in its order, for equal results.
SKILLS = [
    "bilingual", "multilingual", "native english", "english", "spanish", "japanese", "french", "celta", "tefl", "tesol", "ipgce", "jlpt", "cambridge",
    "pearson", "google educator", "content editor", "content writer", "copy editor", "proofreader", "copywriter", "localization specialist",
    "localisation specialist", "linguistic quality assurance", "lqa", "mtpe", "post-editing", "technical writer", "documentation specialist",
    "educational content", "rlhf", "ai trainer", "ai evaluator", "content evaluator", "data annotation", "data annotator", "search quality rater",
    "quality rater", "prompt engineer", "instructional design", "instructional designer", "elearning", "e-learning", "learning and development",
    "l&d", "talent acquisition", "hr coordinator", "hr administrator", "onboarding", "training coordinator", "people operations", "payroll",
    "workday", "bamboohr", "hris", "virtual assistant", "executive assistant", "administrative coordinator", "operations coordinator",
    "project coordinator", "office manager", "event coordinator", "google classroom", "moodle", "articulate rise", "articulate storyline", "lms",
    "education perfect", "sdl trados", "cat tool", "customer success", "customer support", "client relations", "customer experience",
    "guest experience", "google workspace", "microsoft office", "hubspot", "crm", "asana", "trello", "notion", "clickup", "hotel management",
    "hospitality", "opera pms", "front office", "united nations", "unesco", "unicef", "ilo", "oecd", "ngo", "programme assistant",
    "documentation assistant", "project management", "pmp", "capm", "agile", "scrum",
]
CANTONS = {
    "zurich": "ZH", "zürich": "ZH", "zh": "ZH", "bern": "BE", "berne": "BE", "be": "BE", "luzern": "LU", "lucerne": "LU", "lu": "LU", "uri": "UR",
    "ur": "UR", "schwyz": "SZ", "sz": "SZ", "obwalden": "OW", "ow": "OW", "nidwalden": "NW", "nw": "NW", "glarus": "GL", "gl": "GL", "zug": "ZG",
    "zg": "ZG", "fribourg": "FR", "freiburg": "FR", "solothurn": "SO", "so": "SO", "basel-stadt": "BS", "basel": "BS", "bs": "BS", "bâle": "BS",
    "basel-landschaft": "BL", "bl": "BL", "schaffhausen": "SH", "sh": "SH", "appenzell ausserrhoden": "AR", "ar": "AR", "appenzell innerrhoden": "AI",
    "st. gallen": "SG", "st.gallen": "SG", "sg": "SG", "saint-gall": "SG", "graubünden": "GR", "graubunden": "GR", "grisons": "GR", "gr": "GR",
    "aargau": "AG", "argovie": "AG", "ag": "AG", "thurgau": "TG", "thurgovie": "TG", "tg": "TG", "ticino": "TI", "tessin": "TI", "ti": "TI",
    "vaud": "VD", "waadt": "VD", "vd": "VD", "valais": "VS", "wallis": "VS", "vs": "VS", "neuchâtel": "NE", "neuchatel": "NE", "neuenburg": "NE",
    "ne": "NE", "genève": "GE", "geneve": "GE", "geneva": "GE", "genf": "GE", "ge": "GE", "jura": "JU", "ju": "JU",
}
CV_PATTERNS = [
    r"\b(English|Spanish|Japanese|French|Russian|Bilingual|Multilingual|Native English|Native Speaker|IELTS)\b",
    r"\b(CELTA|TEFL|TESOL|IPGCE|JLPT|Cambridge|Pearson|British Council|Google Educator|SEN)\b",
    r"\b(Content Editor|Content Writer|Copy Editor|Proofreader|Copywriter|Localisation Specialist|Localization Specialist|Linguistic Quality Assurance|LQA|MTPE|Post-editor|Post-editing|Technical Writer|Documentation Specialist|Blog Editor|Educational Content)\b",
    r"\b(RLHF|AI Trainer|AI Evaluator|Content Evaluator|Data Annotator|Data Annotation|Search Quality Rater|Quality Rater|Prompt Engineer)\b",
    r"\b(Instructional Designer|Instructional Design|eLearning|e-learning|Learning and Development|L&D|Talent Acquisition|HR Coordinator|HR Administrator|HR Officer|Onboarding Specialist|Training Coordinator|People Operations|People Partner|Payroll|HRIS|Workday|BambooHR)\b",
    r"\b(Virtual Assistant|Executive Assistant|Administrative Coordinator|Operations Coordinator|Project Coordinator|Office Manager|Event Coordinator|Remote Assistant)\b",
    r"\b(Google Classroom|Education Perfect|Moodle|Canvas|Blackboard|Articulate Rise|Articulate Storyline|SDL Trados|CAT Tool|LMS)\b",
    r"\b(Customer Success|Customer Support|Customer Experience|Client Relations|VIP Relations|Concierge|Guest Experience)\b",
    r"\b(Google Workspace|Microsoft Office|HubSpot|CRM|Asana|Trello|Notion|ClickUp|Zoom|Skype)\b",
    r"\b(Hospitality|Hotel Management|Front Office|Opera PMS|BOSS|Revenue Management|Health and Safety)\b",
    r"\b(United Nations|UNESCO|UNICEF|ILO|UNOG|OECD|NGO|Programme Assistant|Documentation Assistant|Language Assistant)\b",
    r"\b(PMP|CAPM|Prince2|Agile|Scrum|Project Management)\b",
]
# End of fixed values.
