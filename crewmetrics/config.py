"""Parameters of the operators. Everything that a report may vary lives here as data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

# --- Fixed values -----------------------------------------------------------

# Clocks: storage is UTC, business time is UTC+7, a production day starts at 06:15 local.
LOCAL_OFFSET_HOURS = 7
DAY_START_MINUTES = 6 * 60 + 15
SHIFT_HOURS = 8
SHIFT_LABELS = ("1_AM", "2_PM", "3_NI")
SHIFT_LABELS_NS = ("1_AM", "2_PM", "3_NS")

# Activity codes that the classifier and the gap operators assign.
IMAGE_PROCESSING = 110
TOOL = 1001
SKYPE = 514
IDLE = 1013
EXPLORER = 310
BROWSER = 1312
MEAL = 1091
LOGOUT = 1092
MEAL_REFERENCE = 1093
OTHER = 411
MEAL_SOURCE_CODE = 12

# Logout reasons.
REASON_END_SHIFT = 6
REASON_MEAL = 7

# Worker roles and cohort groups.
PRODUCING_ROLES = (3, 8, 33)
FREELANCE_ROLE = 8
TEAM_LEADER_ROLE = 9
FREELANCE_GROUP = 999
BOT_GROUP = 998
COHORT_NAME_BLOCKS = ("%demo%", "%test%", "%dev%")
BOT_NAME_PATTERNS = ("auto%", "% bot %")

# Office label prefixes by group id.
OFFICE_PREFIXES = (
    (2, "1"),
    (3, "3"),
    (4, "2"),
    (8, "4"),
    (990, "2_Site Two Partner Worker"),
    (996, "1_Site One Partner Team"),
    (998, "6_AutoBot"),
    (999, "5_Freelancer"),
)

# Codes that are taken over from the log as they are.
DIRECT_CODES = (7, 1, 9, 10, 6, 5, 2, 3, 4, -1, 8)
DIRECT_CODES_14 = (7, 1, 9, 10, 14, 6, 5, 2, 3, 4, -1, 8)

# Application-name patterns: (case folding, LIKE pattern). The pattern of a company's
# own client program is a deployment parameter, see ActivityRules.with_tools.
TOOL_PATTERNS_BASE = (
    ("upper", "%PHOTO EDITOR CLIENT%"),
    ("upper", "PHOTOEDITORCLIENT%"),
    ("upper", "%CALC%"),
    ("asis", "Photoshop"),
    ("asis", "Adobe Photoshop C%"),
    ("asis", "Lightshot"),
    ("asis", "Notepad"),
    ("asis", "Notepad++%%"),
    ("asis", "Snipping Tool"),
    ("asis", "Sticky Notes"),
    ("asis", "7-Zip GUI"),
    ("asis", "WinRAR"),
    ("asis", "Adobe Bridge CC%"),
    ("asis", "Microsoft Excel"),
    ("lower", "%stemain.exe%"),
    ("lower", "stemain"),
    ("lower", "ste"),
    ("lower", "ste launcher"),
    ("lower", "%smooth_path%"),
)
CHROME_PATTERNS = (("upper", "CHROME%"), ("upper", "GOOGLE CHROME%"))
SKYPE_PATTERNS = (("upper", "%SKYPE%"),)
IDLE_PATTERNS = (("upper", "IDLE%"),)
EXPLORER_PATTERNS = (("upper", "%EXPLORER%"),)
BROWSER_PATTERNS_BASE = (
    ("upper", "COCCOC%"),
    ("upper", "COC COC%"),
    ("upper", "INTERNET EXPLORER%"),
    ("upper", "%FIREFOX%"),
    ("asis", "UC Browser"),
    ("asis", "Opera Internet Browser"),
    ("upper", "BROWSER%"),
)
BRAVE_PATTERNS = (("upper", "%BRAVE%"),)

# Activity dictionary: code -> display name.
ACTIVITY_NAMES = {
    110: "1_IPT",
    1: "2_Break",
    7: "3_NoAssignedImage",
    411: "4_Others_",
    1312: "5_Browser_",
    -1: "6_IDLE",
    514: "7_Skype_",
    10: "1__PostProcessingTime",
    2: "9_TrainingMeetingTime",
    3: "9_TrainingMeetingTime",
    4: "9_TrainingMeetingTime",
    310: "a_Explorer_",
    1001: "b_WorkingTool_",
    1013: "b_IDLE_",
    6: "d_NoDownloadedImage",
    5: "e_WorkingOnBrowser",
    9: "f_WaitForDownloading",
    8: "g_SystemErrorTime",
    1091: "l_HaveMeal",
    1093: "l_ref_HaveMeal",
    1092: "l_Logout",
    7116: "1__IPTAndPostProcessing",
    7117: "1__IPTAndPostProcessingWorkOnBrowser",
}
ACTIVITY_NAMES_EWT = {**ACTIVITY_NAMES, 7118: "1__EWT"}
ACTIVITY_NAMES_V1 = {c: n for c, n in ACTIVITY_NAMES.items() if c != 1093}
ACTIVITY_NAMES_14 = {
    **ACTIVITY_NAMES,
    10: "1__FullAutoPostProcessingTime",
    14: "1__SemiAutoPostProcessingTime",
}
ACTIVITY_NAMES_14_SUMMARY = {**ACTIVITY_NAMES_14, 14: "1__SemiPostProcessingTime"}
ACTIVITY_NAMES_PRODUCTION = {
    **ACTIVITY_NAMES,
    10: "1__PostProcessingTime_full",
    14: "1__PostProcessingTime_semi",
    1111: "ProductionTime",
    2222: "Non_ProductionTime",
}

# Roll-up categories: new code -> member codes.
ROLLUPS = {7116: (110, 10), 7117: (110, 10, 5)}
ROLLUPS_EWT = {**ROLLUPS, 7118: (110, 7, 10, 5, 9)}
ROLLUPS_14 = {7116: (110, 10, 14), 7117: (110, 10, 14, 5)}
ROLLUPS_PRODUCTION = {
    **ROLLUPS_14,
    1111: (1, 411, 1312, 514, 310, 1001, 1091, 1092),
    2222: (110, 7, 10, 14, 6, 5, 9),
}

# Code sets of the daily working-time reports.
EWT_CODES = (110, 7, 10, 5, 9)
IPT_POST_CODES = (110, 10)
POST_CODES = (10,)
ALL_TIME_CODES = (110, 1, 7, 411, 1312, -1, 514, 10, 310, 1001, 1013, 6, 5, 9, 8, 1091, 1092)
BREAK_IDLE_CODES = (1, -1, 1013)

# Workers left out of the shift reports.
EXCLUDED_WORKERS = (
    1634, 1645, 2113, 1644, 982, 2023, 1637, 980, 1639, 1890, 2736, 1649, 1027, 1640,
    1031, 2307, 2191, 1922, 1808, 2192, 1831, 1939, 1443, 1925, 3258, 3644, 4201,
)

# Calendar of the daily report.
HOLIDAYS = ("2019-01-01", "2019-04-14", "2019-04-30", "2019-05-01")
SUBSTITUTE_DAYS = ("2019-04-15",)

# Skills of the mastery reports.
MASTERY_SKILLS = (
    121, 5, 43, 479, 44, 160, 9, 22, 29, 10, 6, 65, 40, 46, 16, 13, 14, 3, 8, 74, 75, 521,
    128, 120, 70, 303, 47, 1, 434, 328, 23, 12, 133, 131, 11, 430, 313, 167, 304, 168, 15,
    39, 21, 333, 20, 26, 444, 145, 435, 452, 455, 330, 461, 326, 490, 491, 198, 135, 337,
    458, 480, 488, 484, 486, 426, 438, 439,
)
MASTERY_SKILLS_2021 = MASTERY_SKILLS + (537,)
MASTERY_NAME_BLOCKS = ("Freel%", "Auto%", "auto%", "%demo%", "% Bot %", "%test%", "%dev%")

# Minimum image counts: (skills, monthly minimum, weekly minimum). Skill 479 has
# no weekly entry of its own.
VOLUME_TIERS = (
    ((15, 439, 426), 15, 5),
    ((6, 11, 47, 434, 521), 50, 15),
    ((12, 14, 20, 21, 23, 39, 40, 43, 479, 46, 70, 120, 128, 160, 167, 303, 328, 198, 452,
      455, 480, 486), 100, 25),
    ((13, 5, 10, 16, 44, 121, 133, 304, 461, 135, 458, 484), 200, 50),
    ((1, 22, 29, 65, 337, 430, 444), 500, 125),
)
DEFAULT_VOLUME = 50

# Trimmed-efficiency reports.
PRODUCTION_SKILL_KIND = 0
ACCEPTED_REPORT_STATUS = 10
TRIM_NAME_BLOCKS = ("%bot%",)
TRIM_NAME_BLOCKS_FREE = ("%bot%", "%Free%")

# Customer, template and mask reports.
PERFORMANCE_SKILL_BLOCKS = ("QA G%",)
PERFORMANCE_NAME_BLOCKS = ("auto%",)
TEMPLATE_SKILL_BLOCKS = ("QA %",)
TEMPLATE_NAME_BLOCKS = ("auto%", "Auto%", "%bot%")
MASK_SKILL = 121
MASK_GRADE = "Good"

# --- Rule objects -----------------------------------------------------------


@dataclass(frozen=True)
class ActivityRules:
    """Ordered rules of the activity classifier; the first match wins."""

    direct_codes: tuple[int, ...]
    app_rules: tuple[tuple[int, tuple[tuple[str, str], ...]], ...]
    # Application rules see only rows whose code is known and not the meal source code.
    guard_meal_code: bool = True
    default: int = OTHER

    def with_tools(self, *patterns: tuple[str, str]) -> ActivityRules:
        """The same rules with further application names counted as working tools."""
        grown = tuple(
            (code, known + patterns if code == TOOL else known) for code, known in self.app_rules
        )
        return replace(self, app_rules=grown)


RULES_V2 = ActivityRules(
    DIRECT_CODES,
    (
        (TOOL, TOOL_PATTERNS_BASE + CHROME_PATTERNS),
        (SKYPE, SKYPE_PATTERNS),
        (IDLE, IDLE_PATTERNS),
        (EXPLORER, EXPLORER_PATTERNS),
        (BROWSER, BROWSER_PATTERNS_BASE + BRAVE_PATTERNS),
    ),
)
RULES_V2_14 = ActivityRules(DIRECT_CODES_14, RULES_V2.app_rules)
RULES_V1 = ActivityRules(
    DIRECT_CODES,
    (
        (TOOL, TOOL_PATTERNS_BASE),
        (SKYPE, SKYPE_PATTERNS),
        (IDLE, IDLE_PATTERNS),
        (EXPLORER, EXPLORER_PATTERNS),
        (BROWSER, CHROME_PATTERNS + BROWSER_PATTERNS_BASE),
    ),
    guard_meal_code=False,
)


def volume_table(weekly: bool) -> dict[int, int]:
    """Skill -> minimum image count for the monthly or the weekly reports."""
    table = {s: (week if weekly else month) for skills, month, week in VOLUME_TIERS for s in skills}
    if weekly:
        del table[479]
    return table


@dataclass(frozen=True)
class MinVolume:
    """Minimum image count per skill, with a default for skills not listed."""

    by_skill: dict[int, int] = field(default_factory=dict)
    default: int = DEFAULT_VOLUME


MONTHLY_VOLUME = MinVolume(volume_table(weekly=False))
WEEKLY_VOLUME = MinVolume(volume_table(weekly=True))


@dataclass(frozen=True)
class MasteryRule:
    """How zone bounds and levels follow from the expert quota.

    ``bound`` is "average" (mean efficiency of the experts) or "boundary" (efficiency
    of the last expert, none when a tie skips that rank). The mastery bound adds
    ``mastery_step`` to or multiplies it onto the expert bound; the premaster bound
    does the same from the mastery bound (additive) or the expert bound (factor).
    """

    bound: str
    mastery_step: Decimal
    premaster_step: Decimal
    bound_digits: int
    efficiency_digits: int
    with_expert: bool = True
    share: Decimal = Decimal("0.10")
    # The boundary rule may fall back to the worst expert when a tie skips the rank.
    bridge_ties: bool = False

    @property
    def additive(self) -> bool:
        return self.bound == "average"


AVERAGE_RULE = MasteryRule("average", Decimal("0.3"), Decimal("0.2"), 2, 5)
AVERAGE_RULE_NO_EXPERT = replace(AVERAGE_RULE, with_expert=False)
BOUNDARY_RULE = MasteryRule("boundary", Decimal("1.3"), Decimal("1.5"), 4, 4)
BOUNDARY_RULE_WEEKLY = MasteryRule("boundary", Decimal("1.3"), Decimal("1.5"), 4, 5)
