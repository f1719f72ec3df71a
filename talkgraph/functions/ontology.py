"""Ontology of the graph. Types, relations, evidence weights, thresholds and phrases."""

ENTITY_TYPES = ("Claim", "Method", "Dataset", "Metric", "Result", "Limitation", "Slide", "VisualRegion", "PaperChunk", "Figure", "Table", "Utterance", "ProsodyEvent")

#: relation -> (types of its head, types of its tail)
CONSTRAINTS = {
    "supported_by": (("Claim",), ("Result", "Figure", "Table", "VisualRegion", "PaperChunk")),
    "compares": (("Method", "Result"), ("Method", "Result")),
    "measured_by": (("Result",), ("Metric",)),
    "aligned_to_slide": (("Utterance", "Claim", "Method", "Result"), ("Slide", "VisualRegion")),
    "grounded_in_paper": (("Claim", "Method", "Result", "Slide", "VisualRegion"), ("PaperChunk", "Figure", "Table")),
    "emphasizes": (("ProsodyEvent",), ("Claim", "Method", "Result", "Metric")),
    "referenced_by": (("Figure", "Table", "VisualRegion", "PaperChunk"), ("Utterance", "PaperChunk", "Claim", "Method")),
}
LOGICAL = ("supported_by", "measured_by", "compares", "referenced_by")
#: relation -> weight of evidence from (audio, slide, paper)
WEIGHTS = {
    "aligned_to_slide": (0.2, 0.8, 0.0),
    "emphasizes": (0.8, 0.1, 0.1),
    "supported_by": (0.0, 0.4, 0.6),
    "compares": (0.0, 0.4, 0.6),
    "measured_by": (0.0, 0.4, 0.6),
    "referenced_by": (0.0, 0.4, 0.6),
    "grounded_in_paper": (0.0, 0.2, 0.8),
}
STRONG_MIN, MEDIUM_MIN = 0.75, 0.45
PHRASES = {
    "supported_by": "is supported by",
    "measured_by": "is measured by",
    "compares": "is compared with",
    "referenced_by": "is referenced by",
    "aligned_to_slide": "is aligned to slide content",
    "grounded_in_paper": "is grounded in paper",
    "emphasizes": "emphasizes",
}
METRIC_TERMS = ("accuracy", "precision", "recall", "f1", "auc", "ap", "map", "miou", "iou", "psnr", "ssim", "rmse", "mae", "bleu", "rouge", "wer", "cer")
#: kind of semantic node -> (cue pattern, confidence, how many a session keeps)
CUES = {
    "Claim": (r"\b(we propose|we present|our method|our approach|we introduce|we show|we demonstrate)\b", 0.78, 14),
    "Method": (r"\b(method|framework|network|architecture|pipeline|module|optimizer)\b", 0.72, 16),
    "Result": (r"\b(outperform|state[- ]of[- ]the[- ]art|improve|achieve|better than|superior)\b", 0.74, 20),
    "Limitation": (r"\b(limitation|future work|however|fails|challenge|difficult|still hard)\b", 0.62, 10),
    "Metric": (None, 0.70, 20),
}
#: Summaries of regions that say nothing.
UNINFORMATIVE = r"(?i)\b(blank|empty|no visible text|no textual content|no visual elements|cannot determine)\b"
DISFLUENCY = r"\b(uh|um|erm|hmm|i mean|actually|well|let me rephrase|sorry)\b"
DEICTIC = r"\b(here|this curve|this line|the red line|this figure|this table)\b"
TRANSITION = r"\b(however|but|nevertheless|yet|on the other hand|in contrast)\b"
#: relation a question asks for, by the first group of which a word occurs in it; else supported_by
QUESTION_CUES = (
    ("compares", ("compar", "contrast", "differ", "versus", "vs", "advantage", "better")),
    ("emphasizes", ("emphas", "highlight", "focus", "key point", "stress")),
    ("measured_by", ("metric", "evaluat", "measure", "quantit", "score", "accuracy", "f1", "bleu")),
    ("grounded_in_paper", ("grounded", "backed by", "supported by the paper", "evidence in")),
    ("aligned_to_slide", ("slide", "presentation", "figure", "chart")),
)


def allowed() -> list[tuple[str, str, str]]:
    """Every allowed (head type, relation, tail type)."""
    return [(h, r, t) for r, (heads, tails) in CONSTRAINTS.items() for h in heads for t in tails]
