from . import curation_queries as curation_queries
from . import genotype_queries as genotype_queries
from . import imputation_queries as imputation_queries
from . import quality_queries as quality_queries
from . import read_queries as read_queries
from . import registry as registry
from . import site_queries as site_queries
from . import tag_queries as tag_queries
