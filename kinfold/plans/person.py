"""The person domain: keys, classifiers, merge and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import measures as m
from kinfold.functions import phonetics as p
from kinfold.functions import transforms as t
from kinfold.operators import candidates, classify, fusion
from kinfold.plans.pipeline import Deduplication, DuplicateDetection

# Fixed values of the domain.
WINDOW, THRESHOLD = 20, 0.9


def sorting_keys() -> list[candidates.SortingKey]:
    n = t.normalize_name()
    first, last = n(F.col("firstName")), n(F.col("lastName"))
    return [candidates.sorting_key("First name+Last name", first, last), candidates.sorting_key("Last name+First name", last, first), candidates.sorting_key("Bday+Last name", "birthDate", last)]


def _birth_date() -> m.Measure:
    return m.max_(m.levenshtein().of(t.iso_date()), m.scaled_difference(2, "DAY"))


def classifier() -> classify.RuleBasedClassifier:
    similarity = (
        m.weighted_average()
        .add(2, "firstName", m.max_(m.levenshtein().cutoff(0.5), m.jaro_winkler()))
        .add(2, "lastName", m.max_(m.equality().of(p.beider_morse()), m.levenshtein().cutoff(0.5), m.jaro_winkler()))
        .add(1, "gender", m.equality())
        .add(2, "birthDate", _birth_date())
    )
    return classify.RuleBasedClassifier().default_rule(similarity, THRESHOLD)


def classifier_with_multiple_names() -> classify.RuleBasedClassifier:
    """Names that are split well, joined, swapped or scrambled; the best of these readings counts."""
    split = (
        m.weighted_average()
        .add(1, "firstName", m.max_(m.levenshtein().cutoff(0.9), m.jaro_winkler()))
        .add(1, "lastName", m.max_(m.equality().of(p.beider_morse()), m.levenshtein().cutoff(0.8), m.jaro_winkler()))
    )
    whole = t.concat_names("firstName", "lastName")
    joined = m.levenshtein().cutoff(0.9).of(whole)
    name = m.max_(m.levenshtein().cutoff(0.9), m.jaro_winkler(), m.equality().of(p.beider_morse()))
    swapped = m.stable_matching(name).of(t.fields("firstName", "lastName"))
    scrambled = m.stable_matching(name).of(whole.and_then(t.words()))
    overall = m.max_(split, joined, swapped, scrambled)
    similarity = m.weighted_average().add(4, overall).add(1, "gender", m.equality()).add(2, "birthDate", _birth_date())
    return classify.RuleBasedClassifier().positive_rule("Basic comparison", similarity.scale_with_threshold(THRESHOLD))


def merging() -> fusion.Merge:
    r = fusion
    own = lambda e: F.array_union(F.coalesce(e["fusedIds"], F.array().cast("array<string>")), F.array(e["id"]))
    return (
        r.merge()
        .field("id").with_(r.min_())
        .field("firstName").with_(r.longest(), r.vote())
        .field("lastName").corresponding_to_previous()
        .field("gender").with_(r.assume_equal_value())
        .field("birthDate").with_(r.vote(), r.latest())
        .field("lastModified").with_(r.max_())
        .field("fusedIds", read=own).with_(r.union())
    )


def deduplication(online: bool = True, arrival_col: str = "arrival") -> Deduplication:
    if online:
        select = lambda df: candidates.online_sorted_neighborhood(df, sorting_keys(), "id", arrival_col, WINDOW)
    else:
        select = lambda df: candidates.sorted_neighborhood(df, sorting_keys(), "id", WINDOW)
    detection = DuplicateDetection(select, classifier(), "id", ("firstName", "lastName", "gender", "birthDate"), refine=True)
    return Deduplication(detection, merging(), "source", "lastModified", arrival_col, accept=fusion.accept_all)
