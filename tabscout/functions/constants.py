"""Names, thresholds and word lists whose exact text matters."""

# Learners of the benchmark matrix, in report order.
OFFICIAL_LEARNERS = ["LogisticRegression", "DecisionTree", "RandomForest", "KNN", "SVM", "XGBoost"]

# Case-sensitive spellings accepted by the runner and by the repair step.
STRICT_ALIASES = {
    "logistic_regression": "LogisticRegression",
    "LogisticRegression": "LogisticRegression",
    "decision_tree": "DecisionTree",
    "DecisionTree": "DecisionTree",
    "random_forest": "RandomForest",
    "RandomForest": "RandomForest",
    "knn": "KNN",
    "KNN": "KNN",
    "svm": "SVM",
    "SVM": "SVM",
    "xgboost": "XGBoost",
    "XGBoost": "XGBoost",
}

# Spellings accepted after lower-casing by the finalising step.
FOLDED_ALIASES = {
    "logistic_regression": "LogisticRegression",
    "logisticregression": "LogisticRegression",
    "decision_tree": "DecisionTree",
    "decisiontree": "DecisionTree",
    "random_forest": "RandomForest",
    "randomforest": "RandomForest",
    "knn": "KNN",
    "svm": "SVM",
    "xgboost": "XGBoost",
}

# Spellings accepted by the learner factory, after trimming and lower-casing.
FACTORY_ALIASES = {
    "logistic": "logistic regression",
    "logistic regression": "logistic regression",
    "decisiontree": "decision tree",
    "decision tree": "decision tree",
    "randomforest": "random forest",
    "random forest": "random forest",
    "gradientboosting": "gradient boosting",
    "gradient boosting": "gradient boosting",
    "knn": "knn",
    "k-nearest neighbors": "knn",
    "k nearest neighbors": "knn",
    "naive bayes": "naive bayes",
    "gaussian nb": "naive bayes",
    "svm": "svm",
    "support vector machine": "svm",
    "linear regression": "linear regression",
    "ridge": "ridge",
}

# Selector labels that the factory table does not spell out.
SELECTOR_LABEL_ALIASES = {"logisticregression": "logistic regression"}

CLASSIFIERS = [
    "logistic regression", "decision tree", "random forest", "gradient boosting",
    "knn", "naive bayes", "svm",
]
REGRESSORS = [
    "linear regression", "ridge", "decision tree", "random forest", "gradient boosting",
    "knn", "svm",
]
DEFAULT_CLASSIFIER = "Random Forest"
DEFAULT_REGRESSOR = "Gradient Boosting"

METRICS = ["accuracy", "balanced_accuracy", "f1_score", "precision", "recall", "training_time"]

# Columns a learner log must have before it can be finalised.
LOG_REQUIRED = [
    "task_id", "dataset_id", "dataset_name", "target_column", "model",
    "n_samples", "n_features", "n_classes",
    "accuracy", "balanced_accuracy", "f1_score", "precision", "recall", "training_time",
    "status", "error",
]
LOG_FINAL = LOG_REQUIRED + ["data_source"]
LOG_INTEGERS = ["task_id", "dataset_id", "n_samples", "n_features", "n_classes"]

# Columns of the cleaned log and the ones coerced to numbers in it.
CLEAN_COLUMNS = [
    "task_id", "dataset_id", "dataset_name", "target_column", "model",
    "n_samples", "n_features", "n_classes",
    "numeric_features", "categorical_features", "missing_percentage",
    "accuracy", "balanced_accuracy", "f1_score", "precision", "recall", "training_time",
    "status", "error", "data_source",
]
CLEAN_NUMERIC = [
    "n_samples", "n_features", "n_classes",
    "numeric_features", "categorical_features", "missing_percentage",
] + METRICS

INCOMPLETE_TEXT = "Evaluation marked successful but one or more benchmark metrics are missing."

# Inputs of the learner selector.
SELECTOR_FEATURES = [
    "n_samples", "n_features", "n_classes",
    "numeric_features", "categorical_features", "missing_percentage",
]

# Dataset filter.
EXCLUDED_DATASETS = ["mnist_784", "Fashion-MNIST", "CIFAR_10", "Devnagari-Script"]
MIN_SAMPLES, MIN_FEATURES, MIN_CLASSES = 500, 2, 2
MIN_RUN_ROWS = 10

# Identifier columns.
IDENTIFIER_NAMES = ["id", "index", "record_id", "customer_id", "user_id", "row_id"]
IDENTIFIER_RATIO = 0.80

# Share of rows that must parse before a text column counts as numeric.
NUMERIC_TEXT_SHARE = 0.95

# Text targets that stand for a missing label.
MISSING_LABELS = ["nan", "None", ""]

# Tokens a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

SEED = 42
HOLDOUT = 0.20
FOLDS = 5
ERROR_LENGTH = 500
