"""Train on finished features, judge on held-out ones, and keep the model."""

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from siftward.models.evaluate import classification_report
from siftward.models.train import Settings, ensemble_scores, split_features, train_ensemble
from siftward.sources.writers import save_stages


def train_and_judge(
    features: DataFrame, key: str = "pkg_name", settings: Settings = Settings()
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fitted model, scored test rows and their classification report."""
    train, test = split_features(features, key)
    model = train_ensemble(train, settings)
    scored = ensemble_scores(model, test, settings.voters)
    return model, scored, classification_report(scored)


def train_and_save(
    features: DataFrame, folder: str, moment: datetime, settings: Settings = Settings()
) -> DataFrame:
    """Train, keep the fitted stages, and give the report."""
    model, _, report = train_and_judge(features, settings=settings)
    save_stages(model, folder, moment)
    return report
