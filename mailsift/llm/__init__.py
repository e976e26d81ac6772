"""Operators for training-data pipelines.  Nothing else in the package imports this one."""

from pyspark import cloudpickle

import mailsift

# Workers started elsewhere cannot import the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(mailsift)
