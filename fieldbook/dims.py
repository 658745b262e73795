"""Fixed vocabularies: values that must equal the domain's, stated as text."""

from __future__ import annotations

# Labels of the lost-time categories.
CATEGORY_LABELS = {
    "fishing": "Fishing & Recovery",
    "well_control": "Well Control",
    "wellbore_condition": "Wellbore Condition",
    "bop_equipment": "BOP / Wellhead",
    "mpd": "MPD System Issue",
    "equipment": "Equipment Failure",
    "downhole_tools": "Downhole Tool / BHA Issue",
    "completion": "Completion Failure",
    "formation_testing": "Formation Testing / Well Eval",
    "completion_monitoring": "Completion Monitoring",
    "weather": "Weather / Sea State",
    "waiting_logistics": "Waiting / Logistics",
    "procedural": "Procedural / Safety Standby",
    "other_npt": "Other NPT",
    "mpd_csg_programme": "MPD / Casing Programme",
    "stimulation_programme": "Stimulation Programme",
}

# Category patterns, first matching category wins.
CATEGORY_PATTERNS = [
    ("fishing", [
        r"\bfishing\b", r"\bwashover\b", r"\bjunk mill\b", r"\bmill\b",
        r"\bmagnet\b", r"\bcatcher sub\b", r"\bstacey\b", r"\bmega magnet\b",
        r"\bhtpac\b", r"\binterwell\b", r"\brecovery tool\b",
        r"\bovershot\b", r"\bspear\b",
    ]),
    ("well_control", [
        r"\bkick\b", r"\binflux\b", r"\bshut.?in\b", r"\bwell control\b",
        r"\bshut in drill pipe pressure\b", r"\bsidpp\b", r"\bsicp\b",
        r"\bpit gain\b", r"\bflow check\b", r"\bbarrier\b",
        r"\blost circulation\b", r"\btight hole\b",
    ]),
    ("weather", [
        r"\bwaited on weather\b", r"\bwow\b", r"\bwaiting on weather\b",
        r"\bweather window\b", r"\bweather\b", r"\bsea state\b",
        r"\bwind speed\b", r"\bwave\b.*\bheight", r"\bswell\b",
        r"\bfog\b", r"\bvisibility\b", r"\bcrane\b.*\brest",
        r"\bsupply vessel\b.*\bunabl", r"\bunable to work.*vessel",
        r"\boperational limit\b",
    ]),
    ("bop_equipment", [
        r"\bbop\b.*\b(?:fail|stuck|leak|problem|issue|trip|test)\b",
        r"\b(?:fail|stuck|leak|problem|issue)\b.*\bbop\b",
        r"\bannular\b.*\b(?:fail|stuck|leak|bleed|blew|burst|damage)\b",
        r"\b(?:fail|stuck|leak|blew|burst)\b.*\bannular\b",
        r"\bpipe ram\b", r"\bblind ram\b", r"\bshear ram\b",
        r"\briser\b.*\bfail", r"\bwellhead\b.*\bfail",
        r"\bhp riser\b", r"\besd\b", r"\bpower.?outage\b", r"\bblackout\b",
    ]),
    ("mpd", [
        r"\bmpd\b.*\bfail", r"\bmpd\b.*\btrip", r"\brcd\b.*\bfail",
        r"\bventuri\b.*\bfail", r"\bchoke\b.*\bfail",
        r"\bmpd\b.*\bunable", r"\bpressure\b.*\bunable",
        r"\bsbp\b.*\bunable",
    ]),
    ("formation_testing", [
        r"\brtts\b", r"\bswab\b", r"\badt\b",
        r"\bformation test\b", r"\bwell test\b", r"\bfil test\b",
        r"\bpressure build.?up\b", r"\bflow period\b", r"\bshut.?in period\b",
        r"\bdsm\b", r"\bdsv\b.*\btest", r"\bpressure transient\b",
        r"\bwellbore\b.*\btest\b",
    ]),
    ("completion_monitoring", [
        r"\bfia\b", r"\bfia tool\b", r"\bfia packer\b",
        r"\bwash.*in hole\b", r"\bwash.?pipe\b.*\brih\b",
        r"\blocate.*sleeve\b", r"\bsleeve.*locat",
        r"\bmuster\b", r"\bfire alarm\b", r"\bfalse alarm\b",
        r"\bmonitor.*well\b", r"\bmonitoring well\b",
        r"\bstaged.*pump\b", r"\bpump.*stage",
        r"\bcycled\b",
    ]),
    ("equipment", [
        r"\bprs\b.*\bfail", r"\bprs\b.*\bfault", r"\bprofibus\b",
        r"\bcable\b.*\bfail", r"\bcable\b.*\bfault", r"\bcable\b.*\bdamag",
        r"\bmotor\b.*\bfail", r"\belect.*\bfail", r"\bhydraul.*\bfail",
        r"\bequipment\b.*\bfail", r"\brepair\b", r"\bbreakdown\b",
        r"\bpump\b.*\bfail", r"\bvalve\b.*\bfail", r"\btop.?drive\b.*\bfail",
        r"\bcrane\b.*\bfail",
    ]),
    ("completion", [
        r"\bunable to open\b", r"\bunable to locate\b", r"\bunable to close\b",
        r"\bsleeve\b.*\bunable", r"\bunable.*\bsleeve",
        r"\bpacker\b.*\bleak", r"\bleak\b.*\bpacker",
        r"\bncs\b.*\bunable", r"\bncs.*\bfail",
        r"\bcoil\b.*\bstuck", r"\bstuck\b.*\bcoil",
        r"\bunable to increase pressure\b", r"\bleak\b.*\btest\b.*\bfail",
    ]),
    ("waiting_logistics", [
        r"\bwaiting on\b", r"\bwait.*vessel\b", r"\bwait.*helicopter\b",
        r"\bwait.*parts\b", r"\bwait.*equipment\b", r"\bwait.*service\b",
        r"\bwos\b", r"\bwoc\b", r"\bdelayed\b", r"\bdelay\b.*\bsupply",
        r"\bcustoms\b", r"\bbackload\b.*\bdelay", r"\bno.*available\b",
    ]),
    ("procedural", [
        r"\bpermit\b.*\bdelay", r"\bapproval\b.*\bwait",
        r"\bstandby\b.*\bdecision", r"\bstandby\b.*\bmanagement",
        r"\bconfer.*onshore", r"\bwaiting.*approval",
        r"\bstandby\b.*\bonshore",
    ]),
]

# Op codes that name planned programme work.
OP_CODE_CATEGORY = {
    "MPDCSG": "mpd_csg_programme",
    "MPDDRLG": "mpd_csg_programme",
    "MPDCMT": "mpd_csg_programme",
    "STIM": "stimulation_programme",
    "RPCOMPU PP": "stimulation_programme",
    "XTREEOPS": "stimulation_programme",
    "DRILLOUT": "stimulation_programme",
    "TDTRIP": "formation_testing",
}

# Narrative trouble patterns of the text-classified corpus; their order is in functions.npt.
TROUBLE_PATTERNS = {
    "explicit": r"\b(?:npt|non[- ]productive|down\s*time|downtime|on\s+npt)\b",
    "waiting": r"\bwait(?:ing)?\s+on\s+(?:parts|equipment|water|crew|orders|service|vendor)\b",
    "wait_repairs": r"\bwait(?:ing)?\s+on\s+(?:pump\s+)?repairs?\b",
    "repair_code": r"\brepair\s+rig\b",
    "breakdown": (
        r"\b(?:hydraulic\s+line\s+failed|line\s+failed|went\s+down|bearing\s+broke|repair\s+time|"
        r"module\s+on\s+pump|replacing?\s+pump|replace\s+hydraulic\s+hose|top\s+drive\s+brake|"
        r"damages?\s+beyond\s+repair)\b"
    ),
    "wellbore": (
        r"\b(?:stuck|tight\s+hole|lost\s+tool\s+face|over\s*pull|lost\s+circulation|no\s+returns|"
        r"total\s+losses|partial\s+returns)\b"
    ),
    "fishing": (
        r"\b(?:fishing|fish(?:ing)?\s+bha|milled?\s+up|lost\s+pieces?\s+of\s+bit|junk|"
        r"mill(?:ed)?\s+(?:up\s+)?(?:junk|lost|bit))\b"
    ),
    "downhole": (
        r"\b(?:did\s+not\s+seat|did\s+not\s+set|would\s+not\s+set|lower\s+port\s+did\s+not\s+open|"
        r"lost\s+two\s+packer\s+elements|stator\s+failure|core\s+barrel\s+was\s+jammed)\b"
    ),
}

# Explicit lost-time codes.
EXPLICIT_NPT_CODES = ["T", "NPT", "DOWN", "DOWNTIME"]

# Equipment sub-types, most specific first.
EQUIPMENT_SUBTYPES = [
    ("Pump", r"\bpump\b"),
    ("Top Drive", r"\btop.?drive\b"),
    ("Hydraulic System", r"\bhydraul"),
    ("Motor / Electrical", r"\bmotor\b|\belectric"),
    ("Valve", r"\bvalve\b"),
    ("Cable", r"\bcable\b"),
    ("Crane", r"\bcrane\b"),
]

# Op codes of days without depth gain.
FLAT_EXPECTED = [
    "Run Csg & Cement", "Wire Line Logs", "Test B.O.P.", "Nipple Up B.O.P.",
    "Wait on Cement", "Rig Up & Tear Down", "Cut off Drill Line",
    "Rig Service", "Lubricate Rig", "Clean Out Hole",
]
FLAT_SUPPORT = ["Trips", "Cond Mud & Circ", "Circulating", "Reaming", "Dir Work", "Coring"]
FLAT_BUCKETS = ("Expected (non-drilling)", "Operational / support", "Unclassified — needs review")

# Activity codes counted as trips.
TRIP_CODES = ["TRIP", "POOH", "RIH", "TDTRIP"]

# Categories that are planned programme work, not unplanned causes.
PROGRAMME_CATEGORIES = [
    "mpd_csg_programme", "stimulation_programme", "formation_testing",
    "completion_monitoring", "other_npt",
]

# Default phase order and labels.
PHASES = [
    ("MIRU", "Move In / Rig Up"), ("COND1", "Conductor"), ("INTRM1", "Intermediate 1"),
    ("INTRM2", "Intermediate 2"), ("PROD1", "Production / Reservoir"), ("COMPZN", "Completion / Zonal"),
]

# Question words that ask for an aggregate.
AGGREGATE_KEYWORDS = [
    "maximum", "minimum", "highest", "lowest", "total", "average", "how many", "most", "least",
    "all phases", "across all", "entire well", "cumulative", "sum of", "count of",
]

# Decision wording in operation text.
DECISION_PATTERN = (
    r"recommend|decision\s+made|agreed\s+(?:to|plan)|going\s+forward|action\s+item|mitigat|"
    r"root\s+cause|lesson|next\s+time|prevent"
)


def alternation(patterns: list[str]) -> str:
    """One case-insensitive pattern that matches when any of ``patterns`` does."""
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
