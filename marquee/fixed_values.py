"""Values that results depend on. They are given, not derived."""

# Canonical label -> spellings that stand for it.
LABEL_ALIASES = {
    "action": ["action"],
    "adventure": ["adventure"],
    "animation": ["animation", "animated"],
    "biography": ["biography", "bio"],
    "comedy": ["comedy", "comedies"],
    "crime": ["crime"],
    "documentary": ["documentary", "doc"],
    "drama": ["drama"],
    "family": ["family"],
    "fantasy": ["fantasy"],
    "history": ["history", "historical"],
    "horror": ["horror"],
    "music": ["music", "musical", "musicals"],
    "mystery": ["mystery"],
    "romance": ["romance", "romantic"],
    "sci-fi": ["sci-fi", "science fiction", "scifi", "science-fiction"],
    "sport": ["sport", "sports"],
    "thriller": ["thriller"],
    "war": ["war"],
    "western": ["western"],
    "unknown": ["unknown"],
}

# The main labels a raw label is matched to.
MAIN_LABELS = [
    "action", "adventure", "animation", "biography", "comedy", "crime",
    "documentary", "drama", "family", "fantasy", "history", "horror",
    "musical", "mystery", "romance", "sci-fi", "sport", "thriller",
    "war", "western",
]

# Raw labels that are mapped by hand before any matching.
LABEL_OVERRIDES = {
    "zombie horror": "horror",
    "zombie comedy": "comedy",
    "kung fu": "action",
    "martial arts": "action",
    "costume": "history",
    "suspense": "thriller",
    "sci fi": "sci-fi",
    "science fiction": "sci-fi",
    "youth": "drama",
    "yuen lai-kei": "unknown",
}

# Words that route a chat turn to the catalog.
ROUTING_KEYWORDS = [
    "movie", "film", "recommend", "genre", "director", "actor", "actress",
    "action", "comedy", "drama", "horror", "sci-fi", "thriller", "romance",
    "best", "good", "watch", "cinema", "plot", "cast", "year", "netflix",
    "imdb", "oscar", "award", "blockbuster", "sequel", "franchise",
]

# Query patterns with the slots they hold.
QUERY_TEMPLATES = [
    ("I want movies directed by {director}", [("director", "DIRECTOR")]),
    ("Show me films directed by {director}", [("director", "DIRECTOR")]),
    ("Find movies by {director}", [("director", "DIRECTOR")]),
    ("I want movies with {actor}", [("actor", "CAST")]),
    ("Show me films starring {actor}", [("actor", "CAST")]),
    ("Find movies with {actor1} and {actor2}", [("actor1", "CAST"), ("actor2", "CAST")]),
    ("I want {genre} movies", [("genre", "GENRE")]),
    ("Show me {genre} films", [("genre", "GENRE")]),
    ("Find {genre1} and {genre2} movies", [("genre1", "GENRE"), ("genre2", "GENRE")]),
    ("I want {genre} movies directed by {director}", [("genre", "GENRE"), ("director", "DIRECTOR")]),
    ("Show me {genre} films with {actor}", [("genre", "GENRE"), ("actor", "CAST")]),
    ("Find {genre} movies starring {actor}", [("genre", "GENRE"), ("actor", "CAST")]),
]

# Names used when no catalog is at hand.
FALLBACK_DIRECTORS = [
    "Christopher Nolan", "Quentin Tarantino", "Martin Scorsese", "Steven Spielberg",
    "Ridley Scott", "David Fincher", "Denis Villeneuve", "Jordan Peele",
    "Greta Gerwig", "Rian Johnson", "Chloe Zhao", "Barry Jenkins",
]
FALLBACK_CAST = [
    "Leonardo DiCaprio", "Meryl Streep", "Robert De Niro", "Scarlett Johansson",
    "Tom Hanks", "Jennifer Lawrence", "Brad Pitt", "Angelina Jolie",
    "Will Smith", "Emma Stone", "Ryan Gosling", "Margot Robbie",
    "Denzel Washington", "Viola Davis", "Michael B. Jordan", "Lupita Nyong'o",
]

# Spark ML's default English stop words, so that SQL can use the same list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now i'll you'll "
    "he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't "
    "doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()

# Prompt texts of the summary job.
SUMMARY_PROMPT = """
            Generate a concise, informative summary of the movie "{title}" based on the following plot.
            The summary should be approximately {words} words and should capture the key elements of the story.

            Original plot: {plot}

            Summary:
            """
SUMMARY_PROMPT_NO_SPOILER = """
            Generate a concise, engaging non-spoiler summary of the movie "{title}" based on the following plot.
            The summary should be approximately {words} words and should NOT reveal major plot twists,
            the ending, or key surprises that would spoil the viewing experience.

            Original plot: {plot}

            Non-spoiler summary:
            """
