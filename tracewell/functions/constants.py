"""Values that results depend on."""

# Words that count as missing, matched after trimming and upper-casing.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NAN", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NAN", "NONE", "<NA>")

# Words that are no topics.
STOP_WORDS = tuple("""
the a an and or but in on at to for of with by from up about into through during before after above below between under again further then
once here there when where why how all each few more most other some such no nor not only own same so than too very s t can will just don
should now i you he she it we they what which who this that these those am is are was were be been being have has had having do does did
doing would could ought im youre hes shes its theyre ive youve weve theyve id youd hed shed wed theyd ill youll hell shell well theyll isnt
arent wasnt werent hasnt havent hadnt doesnt dont didnt wont wouldnt couldnt shouldnt my your his her our their me him us them if because as
until while also even much many get got like know think make see one two new want way use go going come take really thing things something
say said people time year years day days good first ve re ll d m let need back still every look www https http com linkedin amp hi hello
""".split())

# English month names, by number from 1.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Fixed value: who has no name of their own.
ANONYMOUS = "linkedin member"

# Days of a connections range; months of an activity or message range.
RANGE_DAYS = {"1m": 30, "3m": 91, "6m": 182, "12m": 365}
RANGE_MONTHS = {"1m": 1, "3m": 3, "6m": 6, "12m": 12}

# What ranges are called.
RANGE_LABELS = {"1m": "Last month", "3m": "Last 3 months", "6m": "Last 6 months", "12m": "Last 12 months", "all": "All time"}

# Stats that say nothing.
BLANK_STATS = ("", "0", "-")

# The tips of the insights and of the message screen.
POST_TIP = "You are sharpest on %s around %02d:00. I would post then."
TOP_AND_FADING_TIP = "%s is your liveliest thread. I would say hello to %s too, quiet for %d days now."
TOP_TIP = "%s is your top contact in this range. I would keep that rhythm going."
NO_CONNECTIONS_TIP = "Upload Connections.csv and I can point out who has gone quiet on you."
SILENT_TIP = "I count %d silent %s. One short hello can wake the list up."

# Icon, accent and text of each insight card; %s is the card's value.
CARDS = {
    "early-bird": ("rooster", "accent-yellow", "Your peak hour is %s. Mornings are your power time."),
    "night-owl": ("owl", "accent-purple", "Your peak hour is %s. Late hours work best for you."),
    "steady-pace": ("calendar", "accent-blue", "Most activity happens around %s. You keep a consistent rhythm."),
    "trending-up": ("rocket", "accent-blue", "Activity is up %s%% compared to the previous period."),
    "slowing": ("sloth", "accent-purple", "Activity is down %s%% compared to the previous period."),
    "topic-shift": ("compass", "accent-purple", "Your focus shifted from %s."),
    "engagement-shift": ("scale", "accent-blue", "%s"),
    "quiet-stretch": ("monkey", "accent-purple", "This period is lighter on activity. A small push could restart momentum."),
    "super-engager": ("handshake", "accent-green", "You comment %sx more than you post. "),
    "topic-master": ("trophy", "accent-yellow", "%s times in your recent activity."),
    "streak": ("flame", "accent-red", "You have a %s-day activity streak going."),
    "weekday": ("calendar", "accent-blue", "%s is your strongest day for activity."),
}

# Texts of the two shifts of engagement, and what is added for the titles of comments per post.
SHIFTS = {"more-engaging": "You are commenting more and posting less than before, leaning into conversations.", "more-posting": "You are posting more and commenting less than before, leaning into creating."}
NOTES = {"Engagement Machine": "Conversations are clearly your superpower.", "Community Builder": "You invest heavily in other people's posts.", "Super Engager": "You build community."}

# Weekdays from Monday.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
