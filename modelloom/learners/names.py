"""Names that appear in result tables and parameters."""

# Model labels.
GENERALIZED_LINEAR = "Generalized linear regression"
RANDOM_FOREST = "Random forest"
NEURAL_NETWORK = "Neural network"
GRADIENT_BOOSTING = "Gradient boosted trees"
DECISION_TREE = "Decision tree"
LOGISTIC = "Logistic regression"
NAIVE_BAYES = "Naive Bayes"
AUTO_ML = "Auto ML"

# Families and links of the generalized linear model.
GLM_FAMILIES = ("gaussian", "poisson", "gamma", "tweedie")
GLM_LINKS = ("identity", "log")

# Activations and losses of the network.
ACTIVATIONS = ("Rectifier", "Maxout", "Tanh", "RectifierWithDropout", "MaxoutWithDropout", "TanhWithDropout")
LOSSES = ("Automatic", "Quadratic", "Huber", "Absolute", "Quantile")

# Families of the search.
SEARCH_FAMILIES = ("DRF", "GLM", "XGBoost", "GBM", "DeepLearning")
