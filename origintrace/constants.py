"""Fixed values of the data model: names, word lists, thresholds."""

# --- fixed values: columns of a raw post dump and of a raw account dump --------------------
TWEET_COLUMNS = [
    "tweetid", "userid", "user_display_name", "user_screen_name", "user_reported_location",
    "user_profile_description", "user_profile_url", "follower_count", "following_count",
    "account_creation_date", "account_language", "tweet_language", "tweet_text", "tweet_time",
    "tweet_client_name", "in_reply_to_userid", "in_reply_to_tweetid", "quoted_tweet_tweetid",
    "is_retweet", "retweet_userid", "retweet_tweetid", "latitude", "longitude", "quote_count",
    "reply_count", "like_count", "retweet_count", "hashtags", "urls", "user_mentions",
]
USER_COLUMNS = [
    "userid", "user_display_name", "user_screen_name", "user_reported_location",
    "user_profile_description", "user_profile_url", "follower_count", "following_count",
    "account_creation_date", "account_language",
]

# --- fixed values: columns of cleaned posts; which of them hold several tokens; the columns that feed each
# --- kind of token; the kinds whose union is compared between accounts, per channel ----------------
DATASET_COLUMNS = [
    "sponsoring_country", "tweetid", "userid", "tweet_text", "user_profile_url",
    "in_reply_to_userid", "in_reply_to_tweetid", "quoted_tweet_tweetid", "retweet_userid",
    "retweet_tweetid", "hashtags", "urls", "user_mentions",
]
LIST_COLUMNS = {"hashtags", "urls", "user_mentions"}
KIND_COLUMNS = {
    "hashtags": ["hashtags"],
    "urls": ["urls", "user_profile_url"],
    "related_tweetids": ["in_reply_to_tweetid", "quoted_tweet_tweetid", "retweet_tweetid", "tweetid"],
    "related_userids": ["user_mentions", "in_reply_to_userid", "retweet_userid", "userid"],
}
CHANNEL_KINDS = {
    "combined": ["hashtags", "urls", "related_tweetids"],
    "users": ["related_userids"],
}

# --- fixed values: countries with dumps, countries modelled, order of the class vector ------
COUNTRIES = [
    "bangladesh", "catalonia", "china", "ecuador", "iran", "russia", "saudi_arabia", "spain",
    "uae", "venezuela",
]
MODELLED_COUNTRIES = ["china", "iran", "russia", "venezuela"]
CLASS_ORDER = ["russia", "china", "iran", "venezuela"]

# --- fixed values: table names that arrive misnamed, and month-first release tokens ---------
TABLE_RENAMES = {
    "bangladesh_linked_tweets_csv_hashed": "bangladesh_201901_tweets_csv_hashed",
    "venezuela_linked_tweets_csv_hashed": "venezuela_201901_2_tweets_csv_hashed",
}
RELEASE_RENAMES = {"082019": "201908", "112019": "201911"}

# --- fixed values: validation split ------------------------------------------------------------
VALIDATION_SHARE = 0.1
SEED = 42

# --- fixed values: set similarity; a pair counts when intersection / union > 1 / 10 -------------
MIN_SIMILARITY = (1, 10)

# --- fixed values: text preparation --------------------------------------------------------------
LANGUAGE = "en"
SPLIT_CHARS = "-@,;=><"
CONTEXT_CHARS = '()?!~".'
SHORT_LINK_PREFIXES = ["https://t.co/", "http://t.co/"]
HASH_DIMENSIONS = 1 << 16
MIN_DOC_FREQ = 5

# The English stop words that ship with Spark MLlib, and "rt".
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
rt
""".split()

# --- fixed values: ensemble --------------------------------------------------------------------
ENSEMBLE_WEIGHTS = (0.5, 0.5)

#: Words after whose full stop a sentence goes on.
ABBREVIATIONS = ["Dr", "Jr", "Mr", "Mrs", "Ms", "Prof", "Sr", "St", "e.g", "i.e", "vs"]
